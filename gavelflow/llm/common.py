"""Shared helpers: the shared folder, table cuts, vectorised word hashing and packed arrays.

Texts arrive in Arrow batches; words and rolling hashes are computed for a
whole batch at once with numpy, never word by word in Python.
"""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = U64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is absent a folder is made here if all runs on this machine; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="gavelflow-")
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    path = f"{top.rstrip('/')}/gavelflow-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


_MADE: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the folders that shared_dir() gave meanwhile, but for those that are added to the set it yields."""
    made, keep = [], set()
    _MADE.append(made)
    try:
        yield keep
    finally:
        _MADE.pop()  # contexts end in the reverse order of their beginning
        for path in made:
            if path not in keep:
                drop_files(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a result of cut() that nothing reads any more."""
    drop_files(df.sparkSession, df.cut_path)


def drop_files(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_dir() gave, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Arrow batches of few bytes while jobs over rows of several megabytes run: a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads the bits of a uint64 array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every k consecutive words of one document: the first word's index, and a uint64 hash."""
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h *= _GRAM
        h += words[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(h[at])


class Texts:
    """The words of a batch of texts, as positions in one byte buffer.

    Words are maximal runs of bytes for which ``is_word`` holds; no word spans
    two texts. Nulls count as empty texts.
    """

    SPACES = np.ones(256, bool)
    SPACES[[0x20, *range(0x09, 0x0E)]] = False
    ALNUM = np.zeros(256, bool)
    ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def __init__(self, texts: pa.Array, is_word: np.ndarray = SPACES, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        self.n = len(texts)
        self.buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.offs = offs - offs[0] if len(texts) else np.zeros(1, np.int64)
        if lower:
            upper = (self.buf >= 0x41) & (self.buf <= 0x5A)
            self.buf = np.where(upper, self.buf | 0x20, self.buf)
        ok = is_word[self.buf]
        start, end = ok.copy(), ok.copy()
        start[1:] &= ~ok[:-1]
        end[:-1] &= ~ok[1:]
        edge = self.offs[(self.offs > 0) & (self.offs < len(ok))]
        start[edge] = ok[edge]
        end[edge - 1] = ok[edge - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.offs, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])  # of each text, its first word

    def hashes(self, most: int = 1 << 21) -> np.ndarray:
        """A uint64 for each word: a polynomial over its bytes, finalised with its length. Taken in spans of about ``most`` bytes."""
        out = np.zeros(len(self.start), U64)
        edges = np.unique(np.concatenate([[0], np.searchsorted(self.start, np.arange(most, len(self.buf), most)), [len(self.start)]]))
        for i, j in zip(edges, edges[1:]):
            lo, hi = self.start[i], self.end[j - 1]
            power, back = (np.full(hi - lo + 1, U64(b)) for b in (_BASE, _BASE_INV))
            power[0] = back[0] = 1
            power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum((self.buf[lo:hi] + U64(1)) * power[:-1], out=total[1:])
            start, end = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (total[end] - total[start]) * back[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(out)

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every k consecutive words of one text: the first word's index, and a uint64 hash."""
        return grams(words, self.doc, k)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by a space, as bytes; and where each word begins there."""
        sizes = self.end - self.start
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(begin[-1], 0x20, np.uint8)
        ok = np.zeros(len(self.buf) + 1, np.int8)
        np.add.at(ok, self.start, 1)
        np.add.at(ok, self.end, -1)
        keep = np.cumsum(ok[:-1]).astype(bool) if len(self.buf) else np.zeros(0, bool)
        # a word that touches the next text's first word opens and closes at one byte; the sum stays 1 there
        mask = np.ones(begin[-1], bool)
        mask[begin[1:] - 1] = False
        out[mask] = self.buf[keep]
        return out, begin


def pack(a: np.ndarray) -> bytes:
    """A numpy array as compressed bytes; byte planes apart, sorted uint64 as differences."""
    kind = a.dtype.str.encode().ljust(4)
    step = a.dtype == U64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
    if step:
        a = np.diff(a, prepend=U64(0))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return kind + bytes([step]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].strip().decode())
    planes = zstandard.ZstdDecompressor().decompress(b[5:]) if len(b) > 5 else b""
    a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=U64) if b[4] else a


def batches(it, rows: int = 0, most_bytes: int = 6_000_000, column: str = "text"):
    """Arrow batches regrouped so that each holds about most_bytes of text (single long texts may exceed it)."""
    for b in it:
        t = pa.Table.from_batches([b]) if isinstance(b, pa.RecordBatch) else b
        sizes = np.asarray(pc.fill_null(pc.binary_length(t[column].cast(pa.large_binary())), 0))
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        for i, j in zip(edges, edges[1:]):
            if j > i:
                yield t.slice(i, j - i)
