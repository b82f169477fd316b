"""Language-model scores by stupid backoff over counts of the whole corpus.

Counts of the n-grams of each order are gathered in a table partitioned by hash
and joined back to the n-grams of every document; the logarithms of the
relative frequencies are summed per document. Both the counting and the join
go through blocks of sorted distinct hashes, one block for each chunk of
documents and hash bucket: what is common is combined before it is shuffled.
Orders follow each other, and an n-gram is only counted if both n-grams one
word shorter occur ``min_count`` times, as no other can occur so often itself.
Texts are split once, into chunks of word numbers in a bucketed table; after
the first order words under ``min_count`` are no longer told apart. Only
questions and answers are shuffled.

An n-gram of two words or more counts as seen if it occurs ``min_count`` times
in the corpus; otherwise the score backs off to the shorter context, times
``backoff``. Single words always have their count. Hashes have 64 bits at every
size: of N distinct n-grams about N^2 / 2^65 pairs share one.

Words are maximal runs of anything but [\\x20\\x09-\\x0D], unchanged.

Defined results: null, empty and blank texts have no words and score 0;
doc_id may be null; repeated rows all count and each get a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import REQUEST, Chunk, ChunkTable, answers, chunk_rows, n_buckets, n_partitions, read_answer, request_rows, rows_of, text_bytes
from .common import U64, cut, grams, pack, release, small_batches, unpack

#: hashes and seen[0]: by word number; seen[n - 1] for longer n-grams: by the position of the first word, 0 where not counted.
STATE = "chunk long, doc_id array<long>, lengths binary, hashes binary, words binary, total long, seen array<binary>"
OUT = "doc_id long, n_words long, n_backoff long, log10_score double, score double"
STATE_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("lengths", pa.binary()), ("hashes", pa.binary()), ("words", pa.binary()), ("total", pa.int64()), ("seen", pa.list_(pa.binary()))])
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log10_score", pa.float64()), ("score", pa.float64())])


class Counts:
    """A chunk with the corpus counts that are known so far, and the distinct n-grams that come next."""

    def __init__(self, row: dict, min_count: int):
        self.row, self.min_count = row, min_count
        self.words, self.lengths = unpack(row["words"]), unpack(row["lengths"]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.hashes = unpack(row["hashes"]) if "hashes" in row else Chunk(row).hashes
        self.total, seen = row.get("total", 0), [unpack(x) for x in row.get("seen", [])]
        self.seen = [seen[0][self.words], *seen[1:]] if seen else []
        if not seen:  # key 0 stands for the number of words
            self.unique = np.concatenate([np.zeros(1, U64), np.maximum(self.hashes, U64(1))])
            self.counts = np.concatenate([[len(self.words)], np.bincount(self.words, minlength=len(self.hashes))])
            return
        before, (at, h) = self.seen[-1], grams(self.hashes[self.words], self.doc, len(seen) + 1)
        ok = (before[at] >= min_count) & (before[np.minimum(at + 1, len(before) - 1)] >= min_count)
        self.at = at[ok]
        self.unique, self.inverse, self.counts = np.unique(h[ok], return_inverse=True, return_counts=True)

    def tell(self, answer: np.ndarray) -> dict:
        """Take the answer to the distinct n-grams in; gives the row of the next state."""
        if len(answer) != len(self.unique):
            raise RuntimeError("an answer does not fit its chunk")
        row = {k: self.row[k] for k in ("chunk", "doc_id", "lengths")}
        if self.seen:
            seen = np.zeros(len(self.words), np.int64)
            seen[self.at] = answer[self.inverse]
            self.seen.append(seen)
            return row | {k: self.row[k] for k in ("hashes", "words", "total")} | {"seen": [*self.row["seen"], pack(seen)]}
        self.total, count = int(answer[0]), answer[1:]
        self.seen.append(count[self.words])
        # numbers below min_count - 1 stand for all words of that count less one; the others follow in the order of their hashes
        often = count >= self.min_count
        number = np.where(often, self.min_count - 2 + np.cumsum(often), count - 1)
        hashes = np.concatenate([np.zeros(self.min_count - 1, U64), self.hashes[often]])
        counts = np.concatenate([np.arange(1, self.min_count), count[often]])
        words = number[self.words].astype(np.uint16 if len(hashes) <= 1 << 16 else np.uint32)
        return row | {"hashes": pack(hashes), "words": pack(words), "total": self.total, "seen": [pack(counts)]}

    def scores(self, backoff: float) -> pa.Table:
        texts = len(self.lengths)
        place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        best, backed = np.log10(np.maximum(1, self.seen[0]) / max(1, self.total)), np.zeros(len(self.words), bool)
        for k in range(2, len(self.seen) + 1):
            last = np.flatnonzero(place >= k - 1)  # words with a context of k - 1 words
            seen, context = self.seen[k - 1][last - k + 1], self.seen[k - 2][last - k + 1]
            ok = seen >= self.min_count
            best[last] = np.where(ok, np.log10(np.maximum(1, seen) / np.maximum(1, context)), np.log10(backoff) + best[last])
            backed[last] = ~ok
        sums = np.bincount(self.doc, best, minlength=texts)
        columns = [np.bincount(self.doc, backed, minlength=texts).astype(np.int64), np.round(sums, 6), np.round(sums / np.maximum(1, self.lengths), 6)]
        return pa.table([pa.array(self.row["doc_id"], pa.int64()), pa.array(self.lengths), *map(pa.array, columns)], schema=OUT_SCHEMA)


def lm_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, n_backoff, log10_score, score (per word) of every row of docs."""
    size = text_bytes(docs)
    buckets, partitions = n_buckets(size), n_partitions(docs, size)

    def request(it):
        for b in it:
            for row in rows_of(b):
                c = Counts(row, min_count)
                yield request_rows(row["chunk"], c.unique, [c.counts.astype(np.uint32)], buckets)

    def merge(chunk, keys, columns):
        _, inverse = np.unique(keys, return_inverse=True)
        return [np.bincount(inverse, columns[0])[inverse].astype(np.int64)], None

    def update(t, answer):
        c = Counts(next(rows_of(t)), min_count)
        return pa.Table.from_pylist([c.tell(read_answer(answer)[0].astype(np.int64))], schema=STATE_SCHEMA)

    def score(t, answer):
        c = Counts(next(rows_of(t)), min_count)
        c.tell(read_answer(answer)[0].astype(np.int64))
        return c.scores(backoff)

    with small_batches(docs.sparkSession):
        state = ChunkTable(chunk_rows(docs, size).drop("part"), partitions)
        release(docs.sparkSession)
        for n in range(1, order):
            told = answers(state.rows().mapInArrow(request, REQUEST), merge, partitions)
            after = ChunkTable(state.rows().groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(update, STATE), partitions, dealt=True)
            state.drop()
            state = after
            del told
            release(docs.sparkSession)
        told = answers(state.rows().mapInArrow(request, REQUEST), merge, partitions)
        out = cut(state.rows().groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, OUT))
    state.drop()
    return out
