"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its lower-cased words. Its features are shingles of five words, each
labelled with its occurrence number. For each of ``sketches`` random orders the
three smallest shingles are kept in the order of the text; texts that agree in
one sketch are candidates. A candidate pair is a link if the labelled shingles
have a Jaccard similarity of ``similarity`` or more and the word sequences an
edit similarity of as much: edits are 1 - ``similarity`` of the longer text's
words at most. Classes are the connected components of the links.

No bucket is expanded into pairs: texts of equal words are one representative;
each member of a bucket is compared with the bucket's first one. Where that
leaves a bucket in more than one component, its members are compared across
components in blocks, those that passed included; a sketch comparison comes
first and pairs that are already connected are skipped. Components are found by
alternating stars over tables, never on the driver.

Defined results: texts without words (null is empty) are near duplicates only
of equal texts; texts under five words have one shingle; a null doc_id sorts
before every other; rows equal in doc_id and text are one text; an empty table
gives an empty result; other columns pass through ``one_of_each``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Texts, batches, cut, mix, release, scratch

NULL_ID = -(1 << 63)
KEPT = 3  # shingles in a sketch
SHINGLE = 5
ROW = "d long, h long, digest binary, n int, keys array<long>, sig binary"
LINK = "ad long, ah long, bd long, bh long, linked boolean"


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _id(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}d").alias("d"), F.col(f"{prefix}h").alias("h"))


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all texts in a row, and where each text's begin (one entry more than texts)."""
    words = texts.hashes()
    at, h = texts.grams(words, SHINGLE)
    doc = texts.doc[at]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < SHINGLE))
    if len(short):
        whole = np.array([mix(np.array([np.bitwise_xor.reduce(words[i:j] * (np.arange(j - i, dtype=U64) * U64(2) + U64(3)))]))[0] for i, j in zip(texts.first[short], texts.first[short + 1])], U64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    # the label: how often the shingle came before in its text
    order = np.lexsort([np.arange(len(h)), h, doc])
    d, x = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    begin = np.flatnonzero(new)
    label = np.empty(len(h), U64)
    label[order] = (np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))).astype(U64)
    h = np.where(label > 0, mix(h + label * U64(0x9E3779B97F4A7C15)), h)
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts.n))])


def sketch(h: np.ndarray, first: np.ndarray, sketches: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Of each text with shingles: its sketch keys, and 32 bits of the shingles in each sketch."""
    n = len(first) - 1
    keys, sig = np.zeros((n, sketches), U64), np.zeros((n, sketches, KEPT), np.uint32)
    has = np.flatnonzero(np.diff(first))
    if not len(has):
        return keys, sig
    begin, sizes = first[has], np.diff(first)[has]
    bits = U64(max(1, int(sizes.max()).bit_length()))
    low = (U64(1) << bits) - U64(1)
    index = (np.arange(len(h)) - np.repeat(begin, sizes)).astype(U64)
    salts = np.random.default_rng(seed).integers(1, 1 << 63, sketches).astype(U64)
    for j, salt in enumerate(salts):
        v = (mix(h ^ salt) & ~low) | index
        found = np.full((len(has), KEPT), low, U64)  # low: none left
        for k in range(KEPT):
            least = np.minimum.reduceat(v, begin)
            found[:, k] = np.where(sizes > k, least & low, low)
            at = begin + (least & low).astype(np.int64)
            v[at[sizes > k]] = ~U64(0)
        ok = found != low
        x = np.where(ok, h[np.minimum(begin[:, None] + np.where(ok, found, U64(0)).astype(np.int64), len(h) - 1)], U64(0))
        sig[has, j] = (x >> U64(32)).astype(np.uint32)
        x = np.take_along_axis(x, np.argsort(found, axis=1, kind="stable"), axis=1)  # in the order of the text
        key = np.full(len(has), salt)
        for k in range(KEPT):
            key = mix(key * U64(0x9E3779B97F4A7C15) + x[:, k])
        keys[has, j] = key
    return keys, sig


def sketches_of(docs: DataFrame, sketches: int) -> DataFrame:
    def run(it):
        for t in batches(it, most_bytes=3_000_000):
            texts = Texts(t["text"], Texts.ALNUM, lower=True)
            h, first = shingles(texts)
            keys, sig = sketch(h, first, sketches)
            out, begin = texts.joined()
            data, raw = memoryview(out.tobytes()), t["text"]
            edges = begin[texts.first]
            digest = [hashlib.blake2b(data[i:j], digest_size=16).digest() if j > i else hashlib.blake2b(b" " + raw[k].as_py().encode(), digest_size=16).digest() for k, (i, j) in enumerate(zip(edges.tolist(), edges[1:].tolist()))]
            n = np.diff(first)
            keys = [k.tolist() if m else [] for k, m in zip(keys.view(np.int64), n)]
            yield pa.RecordBatch.from_arrays([t["d"].combine_chunks(), t["h"].combine_chunks(), pa.array(digest, pa.binary()), pa.array(n.astype(np.int32)), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sig], pa.binary())], names=["d", "h", "digest", "n", "keys", "sig"])

    return _identified(docs).mapInArrow(run, ROW)


class Words:
    """The word and shingle hashes of a column of texts, text by text."""

    def __init__(self, column):
        self.t = Texts(column, Texts.ALNUM, lower=True)
        self.words = self.t.hashes()
        self.h, self.first = shingles(self.t)

    def __getitem__(self, i: int) -> tuple[bytes, np.ndarray]:
        return self.words[self.t.first[i] : self.t.first[i + 1]].tobytes(), self.h[self.first[i] : self.first[i + 1]]


def aligned(a: bytes, b: bytes, limit: int) -> bool:
    """Whether two word sequences (8 bytes a word) are within ``limit`` edits: furthest reaching points, diagonal by diagonal."""
    n, m = len(a) // 8, len(b) // 8
    if abs(n - m) > limit:
        return False

    def run(x: int, y: int) -> int:
        step = 8
        while x < n and y < m:
            k = min(step, n - x, m - y)
            if a[8 * x : 8 * (x + k)] == b[8 * y : 8 * (y + k)]:
                x, y, step = x + k, y + k, step * 2
            elif k == 1:
                break
            else:
                step = max(1, k // 4)
        return x

    reach = {0: run(0, 0)}  # by diagonal x - y
    for d in range(limit + 1):
        if reach.get(n - m, -1) >= n:
            return True
        now = {}
        for k in range(-d - 1, d + 2):
            if abs(k - (n - m)) > limit - d:
                continue
            x = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            x = min(x, n, m + k)
            if x >= max(0, k):
                now[k] = run(x, x - k)
        reach = now
    return False


def within(a: bytes, b: bytes, limit: int) -> bool:
    """The same as ``aligned`` for many edits: a column of the table of edits is two numbers, a bit for each word of a."""
    a, b = (np.frombuffer(x, U64) for x in (a, b))
    m = min(len(a), len(b))
    other = np.flatnonzero(a[:m] != b[:m])
    head = int(other[0]) if len(other) else m
    other = np.flatnonzero(a[len(a) - m + head :][::-1] != b[len(b) - m + head :][::-1])
    tail = int(other[0]) if len(other) else m - head
    a, b = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    if not a or not b:
        return max(len(a), len(b)) <= limit
    at = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    at = {w: sum(1 << i for i in at[w]) for w in set(b) & set(at)}
    every, top, edits = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0  # where the column rises by one, and falls
    for left, w in zip(range(len(b) - 1, -1, -1), b):
        x = at.get(w, 0)
        zero = (((x & up) + up) ^ up) | x | down
        rise, fall = down | (every & ~(zero | up)), zero & up
        edits += bool(rise & top) - bool(fall & top)
        if edits - left > limit:
            return False
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(zero | rise)) & every, rise & zero & every
    return edits <= limit


def similar(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray], least: float) -> bool:
    (aw, ah), (bw, bh) = a, b
    if min(len(ah), len(bh)) < least * max(len(ah), len(bh)):
        return False
    both = len(np.intersect1d(ah, bh, assume_unique=True))
    union = len(ah) + len(bh) - both
    if not both or both < least * union - 1e-9:
        return False
    limit = int((1 - least) * (max(len(aw), len(bw)) // 8) + 1e-9)
    # edits in place lose a shingle or more each, so few suffice for most pairs; moved passages take more
    return aligned(aw, bw, min(limit, union - both)) or (limit > union - both and within(aw, bw, limit))


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (ad, ah, bd, bh) with linked. texts: d, h, text of all that occur in pairs."""

    def run(it):
        for t in it:
            a, b = Words(t["at"]), Words(t["bt"])
            ok = [similar(a[i], b[i], least) for i in range(t.num_rows)]
            yield pa.RecordBatch.from_arrays([t["ad"], t["ah"], t["bd"], t["bh"], pa.array(ok, pa.bool_())], names=["ad", "ah", "bd", "bh", "linked"])

    for side in "ab":
        pairs = pairs.join(texts.select(F.col("d").alias(f"{side}d"), F.col("h").alias(f"{side}h"), F.col("text").alias(f"{side}t")).hint("merge"), [f"{side}d", f"{side}h"])
    return pairs.select("ad", "ah", "bd", "bh", "at", "bt").mapInArrow(run, LINK)


def near_in(t: pa.Table, blocks: tuple, least: float):
    """t (side, n, sig): of each row in turn the later rows that may be near by their sketches, of the other side if there are two blocks."""
    side, size = t["side"].to_numpy(), t["n"].to_numpy()
    sig = np.stack([np.frombuffer(s, np.uint32).reshape(-1, KEPT) for s in t["sig"].to_pylist()])
    for k in range(t.num_rows):
        near = np.zeros(t.num_rows - k - 1)
        for u in range(KEPT):
            for v in range(KEPT):
                near += (sig[k + 1 :, :, u] == sig[k, :, v]).sum(1)
        lo, hi = np.minimum(size[k + 1 :], size[k]), np.maximum(size[k + 1 :], size[k])
        ok = (near >= 0.45 * KEPT * sig.shape[1]) & (lo >= least * hi)
        if blocks[0] != blocks[1]:
            ok &= side[k + 1 :] != side[k]
        yield k + 1 + np.flatnonzero(ok)


def numbered(t: pa.Table) -> np.ndarray:
    """The components of the rows as small numbers."""
    known = {}
    return np.array([known.setdefault(tuple(c.values()), len(known)) for c in t["comp"].to_pylist()])


def open_pairs(groups: DataFrame, least: float) -> DataFrame:
    """The rows of groups (g, i, j, side, d, h, comp, n, sig) that may be near a row of another component there."""

    def run(key, t):
        comp, ok = numbered(t), np.zeros(t.num_rows, bool)
        for k, near in enumerate(near_in(t, key[1:], least)):
            near = near[comp[near] != comp[k]]
            ok[near] = True
            ok[k] |= len(near) > 0
        return t.filter(pa.array(ok))

    return groups.groupBy("g", "i", "j").applyInArrow(lambda key, t: run([x.as_py() for x in key], t), groups.schema)


def rest_links(groups: DataFrame, least: float) -> DataFrame:
    """groups (g, i, j, side, d, h, comp, n, sig, text): links between different components within a block or between two."""

    def run(key, t):
        ids, comp = list(zip(t["d"].to_pylist(), t["h"].to_pylist())), numbered(t)
        words, root, out = Words(t["text"].combine_chunks()), {}, []

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for k, near in enumerate(near_in(t, key[1:], least)):
            for m in near.tolist():
                a, b = find(comp[k]), find(comp[m])
                if a != b and similar(words[k], words[m], least):
                    root[max(a, b)] = min(a, b)
                    out.append((*ids[k], *ids[m], True))
        return pa.table({c: pa.array([o[q] for o in out], pa.bool_() if q == 4 else pa.int64()) for q, c in enumerate(("ad", "ah", "bd", "bh", "linked"))})

    return groups.groupBy("g", "i", "j").applyInArrow(lambda key, t: run([x.as_py() for x in key], t), LINK)


def components(links: DataFrame) -> DataFrame:
    """links (a, b: structs) -> v, root: of every vertex the smallest one it is connected with. Alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def near_classes(docs: DataFrame, similarity: float = 0.8, sketches: int = 16, block: int = 2048) -> DataFrame:
    """d, h, root of every row of docs: root is the struct (d, h) of the first row of its class. Only this table is left behind."""
    with scratch(docs.sparkSession) as keep:
        out = _near_classes(docs, similarity, sketches, block)
        keep.add(out.cut_path)
    return out


def _near_classes(docs: DataFrame, similarity: float, sketches: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    rows = cut(sketches_of(docs, sketches))
    reps = rows.groupBy("digest").agg(F.min(_id()).alias("rep"), F.first("n").alias("n"))
    member = cut(rows.select("d", "h", "digest").distinct().join(reps, "digest").select("d", "h", "rep"))
    own = rows.join(member.where(F.col("rep") == _id()).select("d", "h"), ["d", "h"]).dropDuplicates(["d", "h"])
    own = cut(own.select("d", "h", "n", "keys", "sig"))

    in_bucket = own.select("d", "h", "n", F.explode("keys").alias("key"))
    lead = in_bucket.groupBy("key").agg(F.min(F.struct("d", "h", "n")).alias("lead"), F.max(F.struct("d", "h", "n")).alias("other")).where("lead <> other").drop("other")
    pairs = in_bucket.join(lead, "key").where((F.col("d") != F.col("lead.d")) | (F.col("h") != F.col("lead.h")))
    pairs = pairs.select(F.col("lead.d").alias("ad"), F.col("lead.h").alias("ah"), F.col("d").alias("bd"), F.col("h").alias("bh")).distinct()
    pairs = cut(pairs)
    used = pairs.select("ad", "ah").union(pairs.select("bd", "bh")).toDF("d", "h").distinct()
    # tables that grow with the corpus are met by sorting at every size, not broadcast while they happen to be small
    texts = cut(_identified(docs).join(used.hint("merge"), ["d", "h"]).dropDuplicates(["d", "h"]))
    release(spark)
    done = cut(verify(pairs, texts, similarity))
    release(spark)
    links = done.where("linked").select(_id("a").alias("a"), _id("b").alias("b"))
    roots = components(links)

    # a group is all that met one first row, with that row; only groups in which another component is left are opened
    met = done.select(_id("a").alias("g"), F.col("bd").alias("d"), F.col("bh").alias("h"))
    met = met.union(met.select("g", F.col("g.d").alias("d"), F.col("g.h").alias("h")).distinct())
    met = met.join(roots.select(F.col("v.d").alias("d"), F.col("v.h").alias("h"), "root"), ["d", "h"], "left").withColumn("comp", F.coalesce("root", _id())).drop("root")
    met = cut(met)
    open_ = met.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi and size > 2").select("g", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rest = met.join(open_, "g").withColumn("own", F.pmod(F.xxhash64("d", "h"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("g", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.col("own").alias("side"), "d", "h", "comp")
    rest = cut(open_pairs(rest.join(own.select("d", "h", "n", "sig"), ["d", "h"]), similarity))
    rest = rest.join(texts, ["d", "h"])
    more = cut(rest_links(rest, similarity))
    release(spark)
    if more.limit(1).count():
        roots = components(links.union(more.select(_id("a").alias("a"), _id("b").alias("b"))))
    out = member.join(roots.select(F.col("v").alias("rep"), "root"), "rep", "left")
    return cut(out.select("d", "h", F.coalesce("root", "rep").alias("root")))


def classes(docs: DataFrame, similarity: float = 0.8, sketches: int = 16) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, kept: a row for each row of docs."""
    c = near_classes(docs, similarity, sketches)
    rows = _identified(docs).select("d", "h").join(c, ["d", "h"])
    sizes = cut(rows.groupBy("root").agg(F.count(F.lit(1)).alias("class_size")))
    real = lambda x: F.when(F.col(x) != NULL_ID, F.col(x))
    return rows.join(sizes, "root").select(real("d").alias("doc_id"), real("root.d").alias("class_id"), "class_size", (F.col("root") == _id()).alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, sketches: int = 16) -> DataFrame:
    """The rows of docs that are the first of their class, once each, with all columns."""
    c = near_classes(docs, similarity, sketches).where(F.col("root") == _id()).select(F.col("d").alias("_gf_cd"), F.col("h").alias("_gf_ch"))
    keyed = docs.withColumn("_gf_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_gf_h", F.xxhash64("text"))
    kept = keyed.join(c, (F.col("_gf_d") == F.col("_gf_cd")) & (F.col("_gf_h") == F.col("_gf_ch")), "left_semi")
    return kept.dropDuplicates(["_gf_d", "_gf_h"]).select(*docs.columns)
