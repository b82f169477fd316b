"""Chunks of documents as rows, and the exchange of sorted hash blocks between them and hash buckets.

A chunk is a bounded part of the documents in one row: their ids, lengths in
words, the distinct words and the word numbers, compressed. Chunks are cut
where the documents are read, so no text is shuffled to make them, and texts
are split into words once. A chunk sends each bucket one block of its distinct
sorted keys, so a key that fills the corpus is one entry of each chunk. A bucket
merges the blocks it gets and answers every chunk; nothing is collected.

Chunks and buckets both grow with the square root of the input up to
MOST_CHUNK, so their product, the rows of an exchange, grows in proportion to
the input; beyond, blocks get shorter instead. Rows are never more than the
distinct keys of all chunks, which is what an exchange of single keys would
send.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Texts, batches, drop_files, grams, pack, power_of_two, shared_dir, text_bytes, unpack

CHUNK = "chunk long, part int, doc_id array<long>, lengths binary, vocab binary, words binary"
REQUEST = "bucket int, chunk long, blocks array<binary>"
ANSWER = "chunk long, bucket int, blocks array<binary>"
MOST_CHUNK = 16_000_000


def chunk_bytes(size: int) -> int:
    """Bytes of text in a chunk, for so many bytes of text in all."""
    return int(min(MOST_CHUNK, max(1_000_000, np.sqrt(size * 32e3))))


def n_buckets(size: int, bucket_bytes: int = 12_000_000) -> int:
    return power_of_two(max(64, size / bucket_bytes))


def n_partitions(docs: DataFrame, size: int, bytes_each: int = 32_000_000) -> int:
    """Shuffle partitions for so many bytes: those set for the session, more where a partition would get too large, but no more than a table can have buckets."""
    conf = docs.sparkSession.conf
    most = int(conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(most, max(int(conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each)))


def encoded(t: pa.Table, chunk: int, part: int) -> pa.RecordBatch:
    texts = Texts(t["text"])
    _, first, words = np.unique(texts.hashes(), return_index=True, return_inverse=True)
    buf = texts.buf.tobytes()
    vocab = b" ".join(buf[i:j] for i, j in zip(texts.start[first].tolist(), texts.end[first].tolist()))
    small = np.uint16 if len(first) <= 1 << 16 else np.uint32
    ids = t["doc_id"].combine_chunks() if isinstance(t["doc_id"], pa.ChunkedArray) else t["doc_id"]
    values = {
        "chunk": pa.array([chunk], pa.int64()), "part": pa.array([part], pa.int32()), "doc_id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "lengths": pa.array([pack(texts.n_words.astype(np.uint32))], pa.binary()), "vocab": pa.array([zstandard.ZstdCompressor(level=1).compress(vocab)], pa.binary()), "words": pa.array([pack(words.astype(small))], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))


def chunk_rows(docs: DataFrame, size: int, part=None) -> DataFrame:
    """The documents (doc_id, text) as CHUNK rows; a chunk holds documents of one value of the int column ``part``."""
    most = chunk_bytes(size)

    def run(it: Iterator[pa.RecordBatch]):
        number, waiting, sizes = TaskContext.get().partitionId() << 32, {}, {}
        for t in batches(it, most_bytes=most // 2):
            parts = t["part"].to_numpy()
            for p in np.unique(parts).tolist():
                mine = t.filter(pa.array(parts == p)) if len(parts) > 1 else t
                more = int(pc.sum(pc.binary_length(mine["text"])).as_py() or 0)
                if p in waiting and sizes[p] + more > most:
                    yield encoded(pa.concat_tables(waiting.pop(p)), number, p)
                    number, sizes[p] = number + 1, 0
                waiting.setdefault(p, []).append(mine)
                sizes[p] = sizes.get(p, 0) + more
        for p, tables in waiting.items():
            yield encoded(pa.concat_tables(tables), number, p)
            number += 1

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if part is None else part).cast("int").alias("part"))
    return d.mapInArrow(run, CHUNK)


class Chunk:
    """A chunk read back: doc_id (with nulls), lengths, word numbers, the distinct words and their hashes."""

    def __init__(self, row: dict):
        self.chunk, self.doc_id = row["chunk"], row["doc_id"]
        self.lengths, self.words = unpack(row["lengths"]).astype(np.int64), unpack(row["words"])
        self.joined = zstandard.ZstdDecompressor().decompress(row["vocab"]) if len(self.words) else b""
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])  # of each document, its first word

    @functools.cached_property
    def vocab(self) -> list[bytes]:
        return self.joined.split(b" ") if self.joined else []

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return Texts(pa.array([self.joined], pa.binary())).hashes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return grams(self.hashes[self.words], self.doc, k)


def rows_of(b: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows of a batch one by one, so that one chunk at a time is unpacked."""
    for i in range(b.num_rows):
        yield {k: b[k][i].as_py() for k in b.schema.names}


class ChunkTable:
    """Rows with a column chunk in a table bucketed by it, in the shared folder: passes by chunk read it in place, without a shuffle.

    divide: a column by whose values the files are divided as well. dealt: whether the rows lie in these buckets already.
    """

    def __init__(self, rows: DataFrame, partitions: int, divide: str | None = None, dealt: bool = False):
        self.spark, self.path, self.name = rows.sparkSession, shared_dir(rows.sparkSession), f"gavelflow_{uuid.uuid4().hex}"
        writer = (rows if dealt else rows.repartition(partitions, "chunk")).write.bucketBy(partitions, "chunk").option("path", self.path)
        (writer.partitionBy(divide) if divide else writer).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_files(self.spark, self.path)


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Of sorted keys: (bucket, begin, end) by their highest bits, empty ones left out."""
    shift = 64 - (buckets.bit_length() - 1)
    edges = np.searchsorted(keys, np.arange(buckets, dtype=U64) << U64(shift)) if buckets > 1 else np.zeros(1, int)
    ends = [*edges[1:], len(keys)]
    return [(b, int(i), int(j)) for b, (i, j) in enumerate(zip(edges, ends)) if j > i]


def request_rows(chunk: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    cut = slices(keys, buckets)
    blocks = [[pack(a[i:j]) for a in (keys, *columns)] for _, i, j in cut]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in cut], pa.int32()), pa.array([chunk] * len(cut), pa.int64()), pa.array(blocks, pa.list_(pa.binary()))], names=["bucket", "chunk", "blocks"])


def by_bucket(rows: DataFrame, partitions: int):
    """rows grouped by bucket. Where the session's own number of partitions will do, Spark may make fewer of small ones."""
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition("bucket") if partitions <= own else rows.repartition(partitions, "bucket")).groupBy("bucket")


def answers(requests: DataFrame, merge: Callable, partitions: int, wanted: Callable[[int], bool] = lambda chunk: True) -> DataFrame:
    """merge(chunk number of each entry, keys, columns) gives arrays aligned with the keys, and which entries to answer (None: all).

    Each chunk that is wanted gets its parts of the arrays.
    """

    def run(key, t):
        bucket = key[0].as_py()
        t = t.sort_by("chunk")
        parts = [[unpack(x) for x in row] for row in t["blocks"].to_pylist()]
        sizes = [len(p[0]) for p in parts]
        keys, *columns = (np.concatenate([p[k] for p in parts]) for k in range(len(parts[0])))
        chunks = t["chunk"].to_pylist()
        out, which = merge(np.repeat(np.array(chunks), sizes), keys, columns)
        ends = np.cumsum(sizes)
        if which is not None:
            out, counts = [a[which] for a in out], np.concatenate([[0], np.cumsum(which)])
            sizes = [counts[j] - counts[j - n] for n, j in zip(sizes, ends)]
            ends = np.cumsum(sizes)
        told = [(c, [pack(a[j - n : j]) for a in out]) for n, j, c in zip(sizes, ends, chunks) if n and wanted(c)]
        return pa.table({"chunk": pa.array([c for c, _ in told], pa.int64()), "bucket": pa.array([bucket] * len(told), pa.int32()), "blocks": pa.array([x for _, x in told], pa.list_(pa.binary()))})

    return by_bucket(requests, partitions).applyInArrow(run, ANSWER)


def read_answer(t: pa.Table, columns: int = 1) -> list[np.ndarray]:
    """The answer to one chunk, aligned with its sorted keys."""
    rows = t.sort_by("bucket")["blocks"].to_pylist()
    return [np.concatenate([unpack(r[k]) for r in rows]) if rows else np.zeros(0, U64) for k in range(columns)]


__all__ = ["ANSWER", "CHUNK", "REQUEST", "Chunk", "ChunkTable", "answers", "by_bucket", "chunk_rows", "n_buckets", "n_partitions", "read_answer", "request_rows", "rows_of", "text_bytes"]
