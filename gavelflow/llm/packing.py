"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

A document is its ids and a closing id; only a longer one is cut, into full
pieces and a last shorter one. Pieces are dealt to shards by a hash, so each
shard is a bounded bin-packing problem and the shards run in parallel. Within
a shard pieces go, largest first, where the sum over residual gaps of the
squared number of open bins with that gap becomes smallest (a full bin has no
gap); a bin is opened only where no open one fits. As bins of equal gap are
alike, only counts by gap are searched.

The waste of a shard is at most a few bins, so with tens of thousands of
pieces a shard the number of sequences is within a hair of the bound
ceil(tokens / size).

Defined results: null and empty texts are the closing id alone; repeated rows
each get their own place; doc_id may be null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, size: int, closing: int) -> DataFrame:
    def run(batches):
        from .tokens import WordIds

        ids, tail = WordIds(vocabulary), np.array([closing], "<u4").tobytes()
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                all_ids = ids.ids(text.as_py() or "") + tail
                for i in range(0, len(all_ids), 4 * size):
                    part = all_ids[i : i + 4 * size]
                    for k, v in zip(out, (doc, i // (4 * size), i // 4, len(part) // 4, zlib.crc32(part))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))], names=list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece its bin and its offset there. Pieces of one length are taken together, largest lengths first."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap; full bins have none, so index 0 stays 0
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for at in np.argsort(-lengths, kind="stable"):
        s = int(lengths[at])
        fits = s + np.flatnonzero(count[s:])
        if not len(fits):
            gap, b, made = size, made, made + 1
        else:
            # moving a bin from gap g to g - s changes the sum by 2 (count[g - s] - count[g] + 1), or 1 - 2 count[g] if it fills up
            change = 2 * (count[fits - s] - count[fits] + 1) - (fits == s)
            gap = int(fits[np.argmin(change)])
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[at], offset[at] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offset


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, closing: int = 0, shard_pieces: int = 20_000) -> DataFrame:
    """A row for each piece of each row of docs, with its sequence and offset. shard_pieces: pieces in a shard, about."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    p = cut(pieces(docs, vocabulary, size, closing))  # texts are encoded once
    shards = max(1, round(p.count() / shard_pieces))

    def run(key, t):
        t = t.drop_columns("shard").sort_by([(k, "ascending") for k in ("doc_id", "piece", "length", "ids_crc32")])
        bins, offset = sum_of_squares(t["length"].to_numpy(), size)
        return t.append_column("sequence_id", pa.array(bins * shards + key[0].as_py())).append_column("offset", pa.array(offset))

    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return p.groupBy("shard").applyInArrow(run, PLACED)
