"""Nearest neighbours by a forest of hash prefixes.

Rows are dealt to shards of bounded size by a hash of their id. A shard's
forest has for each tree a sorted array of long hash strings: signs of random
projections. A query descends to its longest matching prefix in every tree and
then all trees ascend together, one bit at a time, until the ranges of equal
prefixes hold enough rows, 3 k different ones beside the query's own at least
(all where there are fewer). These candidates get exact inner products in double
precision. Vectors are extended by one component to equal norms, so that close
hashes mean large inner products. A shard's rows come first in its partition:
its forest is built once, then the queries stream past it in batches, each with
its best answers out at once. The answers are merged per query.

Every row is in the index. ``share`` sets how many prefix hits the ascent
gathers, as a part of the shard's rows, the query's own row not counted; recall for it is measured in the tests
and given in the README.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another length than the query's are no
candidates; rows with the query's vec_id are its own, not candidates; a null
vec_id takes no part; equal scores go to the smaller vec_id; rows that repeat a
vec_id count once, with their best score; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 32
HITS = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector as array<double>, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, seed: int):
        self.ids = ids
        self.known, self.times = np.unique(ids, return_counts=True)
        norms = (vectors**2).sum(1)
        extra = np.sqrt(np.maximum(0, norms.max() - norms))
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, vectors.shape[1] + 1, BITS))
        codes = self.hash(np.column_stack([vectors, extra]))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def hash(self, x: np.ndarray) -> np.ndarray:
        """trees x rows: the hash strings, first bit highest."""
        power = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([(x @ p > 0) @ power for p in self.planes])

    def mask(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rows in one range of each tree."""
        out = np.zeros(self.sorted.shape[1], bool)
        for order, i, j in zip(self.order, lo, hi):
            out[order[i:j]] = True
        return out

    def candidates(self, qid: np.ndarray, queries: np.ndarray, enough: float, k: int):
        """For each query a mask of rows: those in the ranges that all trees ascended to together.

        These hold ``enough`` hits beside those of the query's own rows, and ``k`` other ids, or all rows.
        """
        codes = self.hash(np.column_stack([queries, np.zeros(len(queries))]))
        n = self.sorted.shape[1]
        lo, hi = np.zeros(codes.shape, np.int64), np.full(codes.shape, n, np.int64)
        open_ = np.ones(len(queries), bool)
        known, times = self.known, self.times
        place = np.minimum(np.searchsorted(known, qid), len(known) - 1)
        own = np.where(known[place] == qid, times[place], 0) * len(codes)  # hits of the query's own rows at most
        for length in range(BITS, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            step = 1 << (BITS - length)
            base = codes[:, at] & ~np.int64(step - 1)
            begin = np.stack([np.searchsorted(s, b) for s, b in zip(self.sorted, base)])
            end = np.stack([np.searchsorted(s, b + step) for s, b in zip(self.sorted, base)])
            done = (end - begin).sum(0) - own[at] >= enough
            if length == 0:
                done[:] = True
            else:  # a range of so many rows holds k other ids for sure
                for j in np.flatnonzero(done & ((end - begin).max(0) < (k + 1) * times.max())):
                    found = self.ids[self.mask(begin[:, j], end[:, j])]
                    done[j] = len(np.unique(found[found != qid[at[j]]])) >= k
            lo[:, at[done]], hi[:, at[done]] = begin[:, done], end[:, done]
            open_[at[done]] = False
        for q in range(len(queries)):
            yield self.mask(lo[:, q], hi[:, q])


def matrix(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: ids and vectors."""
    v = t["v"].combine_chunks()
    sizes, flat, ids = np.asarray(v.value_lengths()), np.asarray(v.flatten()), t["vec_id"].to_numpy()
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return {int(n): (ids[sizes == n], flat[begin[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)}


class Shard:
    """The rows of a shard; forests by length of the vectors, made when first asked."""

    def __init__(self, rows: list[pa.Table], trees: int, seed: int):
        self.rows = matrix(pa.concat_tables(rows)) if rows else {}
        self.trees, self.seed, self.forests = trees, seed, {}

    def answer(self, queries: pa.Table, k: int, share: float) -> pa.RecordBatch:
        out = []
        for n, (qid, qv) in matrix(queries).items():
            if n not in self.rows:
                continue
            ids, v = self.rows[n]
            if n not in self.forests:
                self.forests[n] = Forest(ids, v, self.trees, self.seed)
            forest = self.forests[n]
            most = k * int(forest.times.max())
            for i, mask in enumerate(forest.candidates(qid, qv, share * len(v), 3 * k)):
                at = np.flatnonzero(mask & (ids != qid[i]))
                s = v[at] @ qv[i]
                if len(at) > 3 * most:  # those that may be among the k best ids, whatever the order of summation
                    at = at[s >= np.partition(s, -most)[-most] - 1e-9 * (1 + np.abs(s).max())]
                s = (v[at] * qv[i]).sum(1)
                best = np.lexsort([ids[at], -s])
                _, once = np.unique(ids[at][best], return_index=True)
                best = best[np.sort(once)][:k]
                out.append((np.full(len(best), qid[i]), ids[at][best], s[best]))
        a, b, c = (np.concatenate([x[j] for x in out]) if out else np.zeros(0) for j in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64))], names=["query_id", "vec_id", "score"])


def search(queries: DataFrame, rows: DataFrame, k: int = 20, trees: int = 40, share: float = 1.5, shard_rows: int = 8192, block: int = 2048, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its k nearest found among rows. Both: vec_id, embedding. block: queries answered at a time."""
    q, r = usable(queries), usable(rows)
    shards = max(1, -(-r.count() // shard_rows))
    r = r.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long")).withColumn("query", F.lit(False))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("query", F.lit(True))

    def run(batches):
        held, shard, now = [], None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            change = np.flatnonzero(np.diff(t["shard"].to_numpy() * 2 + t["query"].to_numpy(zero_copy_only=False))) + 1
            for i, j in zip([0, *change], [*change, t.num_rows]):
                part = t.slice(i, j - i)
                number, query = part["shard"][0].as_py(), part["query"][0].as_py()
                if number != now:
                    held, shard, now = [], None, number
                if not query:
                    held.append(part)
                    continue
                if shard is None:
                    shard, held = Shard(held, trees, seed), []
                for at in range(0, part.num_rows, block):
                    yield shard.answer(part.slice(at, block), k, share)

    dealt = r.unionByName(q).repartition(max(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards), "shard").sortWithinPartitions("shard", "query")
    hits = dealt.mapInArrow(run, HITS).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
