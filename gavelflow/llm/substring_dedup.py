"""Substring dedup over a log-structured fingerprint index.

The index is a list of immutable runs: Parquet tables with one row for each
hash bucket, its fingerprints sorted, and of each the chunk that has it. A
fingerprint is a rolling hash of words; of the hashes within a window the
smallest stands for it (winnowing), so equal windows have an equal fingerprint
and only about a fifth of all positions are stored. A batch of documents is
made into a run and merge-joined, bucket by bucket, with the runs before it.
The windows around fingerprints that the batch shares, with itself or with
history, are then compared; of the texts only the words about such a
fingerprint are looked at, and of history only where it is shared for the
first time: windows seen are kept with their first document. Windows are equal if two independent 64-bit
hashes are, one of them over BLAKE2 digests of the words. What starts in a document with a smaller doc_id is
removed from the later one. When there are ``fanout`` runs they are compacted
into one.

Documents are kept as chunks of word numbers in a table that is bucketed by
chunk: every pass over them reads it in place, and only answers are shuffled.

Documents must reach the index in the order of doc_id; within a batch any
order does. A window is judged on the input, not on what is left of it.

Defined results: null and empty texts have no words; a null doc_id counts as
the smallest; documents of equal doc_id never remove from each other;
repeated rows each get a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ANSWER, CHUNK, REQUEST, Chunk, ChunkTable, by_bucket, chunk_rows, n_buckets, n_partitions, read_answer, request_rows, rows_of, text_bytes
from .common import U64, Texts, cut, drop_cut, drop_files, exists, grams, pack, release, shared_dir, small_batches, unpack

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
#: marks: the distinct fingerprints, sorted; of each spot the number of its fingerprint and its first word (as steps).
SPOTTED = f"{CHUNK}, marks binary, spot_mark binary, spot_step binary"
RUN = "bucket int, run int, marks binary, chunks binary, several binary"
RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("marks", pa.binary()), ("chunks", pa.binary()), ("several", pa.binary())])
SHARED = "chunk long, bucket int, blocks array<binary>, newest boolean"
NULL_ID = -(1 << 63)
KNOWN = -1  # stands for a chunk in rows of windows that earlier batches have seen


def smallest(h: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """From every place on the smallest of ``steps`` hashes, and how far off it stands (leftmost). Places near the end have none."""
    n = max(0, len(h) - steps + 1)
    best, where = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, steps):
        other = h[j : j + n]
        less = other < best
        np.copyto(best, other, where=less)
        where[less] = j
    return best, where


def starts(doc: np.ndarray, window: int) -> np.ndarray:
    """The places from which ``window`` words are of one document."""
    return np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)


def spotted(chunks: DataFrame, window: int, gram: int) -> DataFrame:
    """CHUNK rows with their fingerprints."""

    def run(it):
        for b in it:
            for i, row in enumerate(rows_of(b)):
                c = Chunk(row)
                at, h = c.grams(gram)
                every = np.full(len(c.words), ~U64(0))
                every[at] = h
                begin = starts(c.doc, window)
                spots = np.unique(begin + smallest(every, window - gram + 1)[1][begin])
                marks, number = np.unique(every[spots], return_inverse=True)
                steps = np.diff(spots, prepend=0)
                more = [pack(marks), pack(number.astype(np.uint32)), pack(steps.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, *(pa.array([x], pa.binary()) for x in more)], names=[*b.schema.names, "marks", "spot_mark", "spot_step"])

    return chunks.mapInArrow(run, SPOTTED)


class Spots(Chunk):
    def __init__(self, row: dict):
        super().__init__(row)
        self.marks, self.spot_mark, self.spots = unpack(row["marks"]), unpack(row["spot_mark"]), np.cumsum(unpack(row["spot_step"]).astype(np.int64))
        self.ids = np.array([NULL_ID if i is None else i for i in self.doc_id], np.int64)

    def around(self, shared: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that have one of the sorted ``shared`` fingerprints: first word, hash, second hash over BLAKE2 digests of the words.

        Only the words about the spots of these fingerprints are looked at.
        """
        spots = self.spots[_isin(self.marks, shared)[self.spot_mark]]
        lo = np.maximum(spots - (window - gram), self.first[self.doc[spots]])
        hi = np.minimum(spots + window, self.first[self.doc[spots] + 1])
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, lo, 1)
        np.add.at(change, hi, -1)
        inside = np.cumsum(change[:-1]) > 0
        where = np.flatnonzero(inside)
        # pieces are told apart by a number that grows from piece to piece and from document to document
        piece = (np.cumsum(inside & ~np.concatenate([[False], inside[:-1]])) + self.doc)[where]
        need, words = np.unique(self.words[where], return_inverse=True)
        used = [self.vocab[i] for i in need.tolist()]
        hashes = Texts(pa.array([b" ".join(used)], pa.binary())).hashes()
        known = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in used), U64)
        every = np.full(len(where), ~U64(0))
        at, h = grams(hashes[words], piece, gram)
        every[at] = h
        at, key = grams(hashes[words], piece, window)
        second = grams(known[words], piece, window)[1]
        ok = _isin(smallest(every, window - gram + 1)[0][at], shared)
        return where[at[ok]], key[ok], second[ok]


def _first(keys: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each distinct key, sorted: itself, its smallest doc, whether it has several docs."""
    order = np.lexsort([doc, *keys[::-1]])
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1 if len(begin) else begin
    return [k[begin] for k in keys], doc[begin], doc[begin] != doc[end]


def _isin(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def _run_row(bucket: int, run: int, marks: list, chunks: list, several: list) -> pa.Table:
    """The entries of one bucket, sorted by fingerprint and chunk."""
    marks, chunks, several = map(np.concatenate, (marks, chunks, several))
    order = np.lexsort([chunks, marks])
    return pa.Table.from_pylist([{"bucket": bucket, "run": run, "marks": pack(marks[order]), "chunks": pack(chunks[order]), "several": pack(several[order])}], schema=RUN_SCHEMA)


class Index:
    """Runs of fingerprints, and of windows seen around shared ones, in the shared folder. buckets stays as it is for the life of an index."""

    def __init__(self, spark, buckets: int, partitions: int, fanout: int = 3):
        self.spark, self.buckets, self.partitions, self.fanout, self.runs, self.seen, self.compactions = spark, buckets, partitions, fanout, [], [], 0

    def table(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*self.runs)

    def append(self, requests: DataFrame, run: int) -> None:
        """Add the fingerprints of a batch (REQUEST rows) as a run."""

        def merge(key, t):
            blocks = [[unpack(x) for x in row] for row in t["blocks"].to_pylist()]
            chunks = [np.full(len(marks), chunk, np.int64) for (marks, _), chunk in zip(blocks, t["chunk"].to_pylist())]
            return _run_row(key[0].as_py(), run, [x for x, _ in blocks], chunks, [x for _, x in blocks])

        self.runs.append(self._write(by_bucket(requests, self.partitions).applyInArrow(merge, RUN)))

    def _write(self, rows: DataFrame) -> str:
        path = shared_dir(self.spark)
        rows.write.parquet(path)
        return path

    def shared(self, run: int) -> DataFrame:
        """The merge join of a run with itself and those before: to each chunk the fingerprints that the run shares with another document; newest: whether it is a chunk of that run.

        Chunks of history are told only what is shared for the first time: the windows of the rest are known.
        """

        def join(key, t):
            marks, chunks, several = ([unpack(x) for x in t[k].to_pylist()] for k in ("marks", "chunks", "several"))
            new = np.repeat(t["run"].to_numpy() == run, [len(x) for x in marks])
            marks, chunks, several = map(np.concatenate, (marks, chunks, several))
            distinct, inverse, counts = np.unique(marks, return_inverse=True, return_counts=True)
            shared = (counts > 1) | (np.bincount(inverse, several) > 0)
            before = (np.bincount(inverse, ~new) > 1) | (np.bincount(inverse, several & ~new) > 0)
            ok = np.where(new, shared[inverse], (shared & ~before & (np.bincount(inverse, new) > 0))[inverse])
            order = np.flatnonzero(ok)[np.lexsort([marks[ok], chunks[ok]])]
            owners, begin = np.unique(chunks[order], return_index=True)
            blocks = [[pack(part)] for part in np.split(marks[order], begin[1:])] if len(owners) else []
            return pa.table({"chunk": pa.array(owners, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(owners), pa.int32()), "blocks": pa.array(blocks, pa.list_(pa.binary())), "newest": pa.array(new[order][begin])})

        return by_bucket(self.table(), self.partitions).applyInArrow(join, SHARED)

    def compact(self, run: int) -> None:
        """Merge all runs into one, numbered ``run``, when there are fanout of them."""
        if len(self.runs) >= self.fanout:

            def merge(key, t):
                return _run_row(key[0].as_py(), run, *([unpack(x) for x in t[k].to_pylist()] for k in ("marks", "chunks", "several")))

            old, self.runs = self.runs, [self._write(by_bucket(self.table(), self.partitions).applyInArrow(merge, RUN))]

            def together(key, t):
                keys, digests, doc = (np.concatenate(x) for x in zip(*([unpack(b) for b in row] for row in t["blocks"].to_pylist())))
                order = np.lexsort([digests, keys])
                return pa.table({"chunk": pa.array([KNOWN], pa.int64()), "bucket": pa.array([key[0].as_py()], pa.int32()), "blocks": pa.array([[pack(x[order]) for x in (keys, digests, doc)]], pa.list_(pa.binary()))})

            if self.seen:
                old, self.seen = old + self.seen, [self._write(by_bucket(self.windows(), self.partitions).applyInArrow(together, ANSWER))]
            self.compactions += 1
            for path in old:
                drop_files(self.spark, path)

    def windows(self) -> DataFrame | None:
        """The windows that were around shared fingerprints so far, each with its first document."""
        return self.spark.read.schema(ANSWER).parquet(*self.seen) if self.seen else None

    def drop(self) -> None:
        for path in self.runs + self.seen:
            drop_files(self.spark, path)


def fingerprints(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(it):
        for b in it:
            for row in rows_of(b):
                c = Spots(row)
                (keys,), _, several = _first([c.marks[c.spot_mark]], c.ids[c.doc[c.spots]])
                yield request_rows(row["chunk"], keys, [several], buckets)

    return chunks.mapInArrow(run, REQUEST)


def first_windows(chunks: DataFrame, shared: DataFrame, known: DataFrame | None, buckets: int, partitions: int, window: int, gram: int) -> DataFrame:
    """Of the windows around shared fingerprints the first document, told to every chunk of the newest part that has them (SHARED rows).

    known: windows of earlier batches, as the rows of chunk KNOWN that this gives for those not in it.
    """

    def run(t, answer):
        out = []
        if t.num_rows and answer.num_rows:
            row = next(rows_of(t))
            c = Spots(row)
            at, key, digest = c.around(read_answer(answer)[0], window, gram)  # buckets are in the order of the keys, so the answer is sorted
            (keys, digests), doc, several = _first([key, digest], c.ids[c.doc[at]])
            out = [request_rows(row["chunk"], keys, [digests, doc, several, np.full(len(keys), row["newest"])], buckets)]
        return pa.Table.from_batches(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blocks", pa.list_(pa.binary()))]))

    def merge(key, t):
        chunks, parts = t["chunk"].to_pylist(), [[unpack(x) for x in row] for row in t["blocks"].to_pylist()]
        # known windows come with the first document alone
        parts = [p if len(p) == 5 else [*p, np.zeros(len(p[0]), bool), np.zeros(len(p[0]), bool)] for p in parts]
        owner = np.repeat(np.arange(len(chunks)), [len(p[0]) for p in parts])
        keys, digests, doc, several, newest = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.lexsort([doc, digests, keys])
        k, d = keys[order], digests[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        more = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
        first, tell = np.empty(len(k), np.int64), np.empty(len(k), bool)
        first[order], tell[order] = doc[order][begin][group], more[group]
        tell &= newest
        rows, edges = [], np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        for o in np.unique(owner[tell]).tolist():
            at = edges[o] + np.flatnonzero(tell[edges[o] : edges[o + 1]])
            rows.append((chunks[o], [pack(x[at]) for x in (keys, digests, first)]))
        old = np.bincount(group, np.array([c == KNOWN for c in chunks])[owner][order]) > 0 if KNOWN in chunks else np.zeros(len(begin), bool)
        rows.append((KNOWN, [pack(x[begin][~old]) for x in (k, d, doc[order])]))
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blocks": pa.array([x for _, x in rows], pa.list_(pa.binary()))})

    asked = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, REQUEST)
    if known is not None:
        asked = asked.unionByName(known)
    return by_bucket(asked, partitions).applyInArrow(merge, ANSWER)


def removals(chunks: DataFrame, shared: DataFrame, first: DataFrame, window: int, gram: int) -> DataFrame:
    def run(t, answer):
        c = Spots(next(rows_of(t)))
        gone = np.zeros(len(c.words), bool)
        told = answer.filter(pc.field("first")).drop_columns("first")
        if told.num_rows:
            keys, digests, doc = read_answer(told, 3)
            at, key, digest = c.around(read_answer(answer.filter(~pc.field("first")).drop_columns("first"))[0], window, gram)
            own, place, over = c.ids[c.doc[at]], np.searchsorted(keys, key), np.zeros(len(at), bool)
            # a window's entry among those of its hash; nearly always there is but one
            for step in range(int(np.unique(keys, return_counts=True)[1].max())):
                k = np.minimum(place + step, len(keys) - 1)
                over |= (keys[k] == key) & (digests[k] == digest) & (doc[k] < own)
            change = np.zeros(len(c.words) + 1, np.int64)
            np.add.at(change, at[over], 1)
            np.add.at(change, at[over] + window, -1)
            gone = np.cumsum(change[:-1]) > 0
        n = len(c.lengths)
        removed = np.bincount(c.doc, gone, minlength=n).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(c.lengths - removed)])
        kept = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(c.vocab, pa.large_binary()).take(pa.array(c.words[~gone])))
        sha = [hashlib.sha256(x).hexdigest() for x in pc.binary_join(kept, pa.scalar(b" ", pa.large_binary())).to_pylist()]
        return pa.table([pa.array(c.doc_id, pa.int64()), pa.array(c.lengths), pa.array(removed), pa.array(sha, pa.string())], schema=OUT)

    told = shared.withColumn("first", F.lit(False)).unionByName(first.withColumn("first", F.lit(True)))
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """A row for each row of docs: words, removed words, digest of the kept ones. batches: into so many the documents are divided, by doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(docs)
    buckets, partitions = n_buckets(size, 4_000_000), n_partitions(docs, size)
    edges = sorted({int(e) for e in docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    part = sum((F.when(key > e, 1).otherwise(0) for e in edges), F.lit(0))
    with small_batches(spark):
        corpus, index, out = ChunkTable(spotted(chunk_rows(docs, size // batches, part), window, gram), partitions, "part"), Index(spark, buckets, partitions, fanout), None
        release(spark)
        for i in range(len(edges) + 1):
            batch = corpus.rows().where(F.col("part") == i)
            index.append(fingerprints(batch.drop("part"), buckets), i)
            shared = cut(index.shared(i))
            history = corpus.rows().where(F.col("part") <= i).withColumn("newest", F.col("part") == i).drop("part")
            first, path = first_windows(history, shared.drop("newest"), index.windows(), buckets, partitions, window, gram), shared_dir(spark)
            first.withColumn("known", F.col("chunk") == KNOWN).write.partitionBy("known").parquet(path)
            release(spark)
            told = spark.read.schema(ANSWER + ", known boolean").parquet(path).where("NOT known").drop("known")
            done = cut(removals(batch.drop("part"), shared.where("newest").drop("newest"), told, window, gram))
            if exists(spark, f"{path}/known=true"):
                index.seen.append(f"{path}/known=true")
            drop_files(spark, f"{path}/known=false")
            drop_cut(shared)
            release(spark)
            out = done if out is None else out.unionByName(done)
            index.compact(i)
    index.drop()
    corpus.drop()
    return out
