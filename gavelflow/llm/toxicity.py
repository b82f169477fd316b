"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause: insults (words, or word beginnings for
inflected ones) and threats emit weights; targets, negation and reported speech
are tables of states that mark words, composed into one table by their product.
An insult or a threat counts more near a target, less after a negation or in
reported speech. What is scored is the matched clause, read whole, not the
word. The clause weights of a text, their maximum and the text's length give
its score by a logistic curve.

The insult lexicon has a fixed part and a part learned from labelled rows:
words and word beginnings that toxic texts have and others lack. It and the
curve are fitted on at most ``sample`` labelled rows with texts of ``longest``
bytes at most, those with the smallest hashes of their doc_id, so that the
driver holds sample x longest bytes at most; every text is then scored whole.
Labels, language, source and doc_id are never inputs of a score.

Defined results: null and empty texts get the score of a text without any
match; a null doc_id is never held out and never trained on; labels that are
null are not trained on; repeated rows each get a row; with no labels of both
kinds the built-in weights are used; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;\n]")

#: The grammar's built-in words.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb imbecile filth vermin jerk bastard".split()
THREATS = "kill hurt destroy murder beat burn crush hang shoot".split()
TARGETS = "you your yours he his she her they them their this that these those".split()
NEGATIONS = "not never no cannot hardly isn aren wasn kein keine nicht nie pas jamais ne nunca".split()
REPORTS = "said says say wrote writes claimed claims called quoted quotes sagte schrieb dit écrit dijo escribió".split()

#: Default weights; fitted ones replace BUILT_IN and CURVE.
BUILT_IN, THREAT, NEAR_TARGET, NEGATED, REPORTED = 4.0, 2.0, 1.15, 0.5, 0.6
CURVE = (-3.0, 1.0, 0.5, 0.0)


#: What a word is to the transducers of context; every other word is OTHER.
OTHER, TARGET, NEGATION, REPORT = range(4)
KIND = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)


@dataclass(frozen=True)
class Transducer:
    """A table by state and kind of word: the next state, and the marks that the word gets. State 0 is the start."""

    next: tuple[tuple[int, ...], ...]
    marks: tuple[tuple[tuple[bool, ...], ...], ...]

    def run(self, kinds: list[int]) -> list[tuple[bool, ...]]:
        state, out = 0, []
        for k in kinds:
            out.append(self.marks[state][k])
            state = self.next[state][k]
        return out

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both, reading the same words side by side: states are the pairs that can be reached."""
        pairs, known = [(0, 0)], {(0, 0): 0}
        for a, b in pairs:
            for k in range(4):
                after = (self.next[a][k], other.next[b][k])
                if after not in known:
                    known[after] = len(pairs)
                    pairs.append(after)
        step = tuple(tuple(known[self.next[a][k], other.next[b][k]] for k in range(4)) for a, b in pairs)
        return Transducer(step, tuple(tuple(self.marks[a][k] + other.marks[b][k] for k in range(4)) for a, b in pairs))


def after(kind: int, words: int, itself: bool = True) -> Transducer:
    """Marks the words up to ``words`` after one of a kind, and that one itself if so wished."""
    states = range(words + 1)  # words that are still to be marked
    return Transducer(tuple(tuple(words if k == kind else max(0, s - 1) for k in range(4)) for s in states), tuple(tuple((s > 0 or (itself and k == kind),) for k in range(4)) for s in states))


def ever(kind: int) -> Transducer:
    """Marks a word of a kind and all that follow."""
    return Transducer(tuple(tuple(int(s or k == kind) for k in range(4)) for s in (0, 1)), tuple(tuple((bool(s) or k == kind,) for k in range(4)) for s in (0, 1)))


#: Read from the left: near a target before it, negated, reported. Read from the right: a target follows.
CONTEXT = after(TARGET, 3) @ after(NEGATION, 2) @ ever(REPORT)
FOLLOWED = after(TARGET, 2, itself=False)


@dataclass
class Grammar:
    """weights: insult -> weight; an entry ending in * is a word beginning."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, BUILT_IN))
    curve: tuple[float, float, float, float] = CURVE

    def __post_init__(self):
        threats = {w: THREAT for w in THREATS}
        self.words = threats | {k: v for k, v in self.weights.items() if k[-1] != "*"}
        self.starts = {k[:-1]: v for k, v in self.weights.items() if k[-1] == "*"}
        self.lengths = sorted({len(k) for k in self.starts}, reverse=True)
        either = sorted([*map(re.escape, self.words), *(re.escape(k) + r"[^\W\d_]*" for k in self.starts)], key=len, reverse=True)
        self.hit = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(either)})(?![^\W\d_])")

    def emit(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.starts[word[:n]] for n in self.lengths if word[:n] in self.starts), default=0.0)

    def clause(self, words: Iterable[str]) -> float:
        """The weight that the composed transducers give a clause: insults and threats emit theirs, changed by the marks of their words."""
        words = list(words)
        kinds = [KIND.get(w, OTHER) for w in words]
        marks, followed = CONTEXT.run(kinds), FOLLOWED.run(kinds[::-1])[::-1]
        out = 0.0
        for w, (near, negated, _), (target_after,) in zip(words, marks, followed):
            weight = self.emit(w)
            if weight and (w not in THREATS or near or negated):  # a threat needs a target or a negation before it to count at all
                out += weight * (NEAR_TARGET if near else 1.0) * (NEGATED if negated else 1.0) * (NEAR_TARGET if target_after else 1.0)
        return out * (REPORTED if marks and marks[-1][2] else 1.0)  # the weight of the state that the clause ends in

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Sum and maximum of the clause weights, and the logarithm of the length in words."""
        text = (text or "").lower()
        total = most = 0.0
        end = -1
        for m in self.hit.finditer(text):
            if m.start() < end:  # its clause has been read
                continue
            begin = max(text.rfind(c, 0, m.start()) for c in ".!?;\n") + 1
            stop = CLAUSE.search(text, m.end())
            end = stop.start() if stop else len(text)
            weight = self.clause(w[0] for w in WORD.finditer(text, begin, end))
            total, most = total + weight, max(most, weight)
        return total, most, float(np.log1p(text.count(" ")))

    def score(self, text: str | None) -> float:
        a, b, c, d = self.curve
        total, most, size = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * np.log1p(most) + d * size, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, longest: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``sample`` labelled rows that are not held out."""
    labels = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = labels.orderBy(F.xxhash64("id"), "id", "y").limit(sample)  # bounded, hence broadcast
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= longest
    rows = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("text")).limit(sample)
    return [(r["text"] or "", int(r["y"] > 0)) for r in rows.select("text", "y").collect()]


def one_of_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without (near) copies of earlier ones: those with the same smallest hash of five words. Copies would pass for evidence."""
    seen: set[int] = set()
    out = []
    for text, y in rows:
        w = text.split()
        key = min(crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4)))
        if key not in seen:
            seen.add(key)
            out.append((text, y))
    return out


def learn_lexicon(rows: list[tuple[str, int]], most: int = 64, least_share: float = 0.02) -> dict[str, float]:
    """Words and word beginnings (3 to 8 letters) that toxic texts have much oftener than others.

    Taken greedily by information gain; a chosen entry takes its words out of the
    counts of the others. A word counts at most three times a text.
    """
    rows = one_of_copies(rows)
    counts = [Counter(), Counter()]
    texts: dict[str, set[int]] = {}
    for i, (text, y) in enumerate(rows):
        for w, n in Counter(WORD.findall(text.lower())).items():
            counts[y][w] += min(3, n)
            if y:
                texts.setdefault(w, set()).add(i)
    n_toxic = sum(y for _, y in rows)
    share = sum(counts[1].values()) / max(1, sum(counts[0].values()) + sum(counts[1].values()))
    names: dict[str, int] = {}
    word_ids, entry_ids = array("q"), array("q")
    words = sorted({*counts[0], *counts[1]})
    begun = {w[:n] for w in texts for n in range(3, 9)}
    for i, w in enumerate(words):
        for e in ({w} if w in texts else set()) | {w[:n] + "*" for n in range(3, min(8, len(w) - 1) + 1) if w[:n] in begun}:
            word_ids.append(i)
            entry_ids.append(names.setdefault(e, len(names)))
    word_ids, entry_ids = np.array(word_ids, int), np.array(entry_ids, int)
    toxic, clean = (np.array([c[w] for w in words], float) for c in (counts[1], counts[0]))
    entries = list(names)
    prefer = np.array([1 + 0.002 * len(e) + 0.01 * (e[-1] != "*") for e in entries])  # of near equals the narrowest
    out: dict[str, float] = {}
    for _ in range(most):
        t, c = (np.bincount(entry_ids, x[word_ids], len(entries)) for x in (toxic, clean))
        rate = (t + 0.5) / (t + c + 1)
        gain = np.where(rate * (1 - share) > 6 * share * (1 - rate), t * np.log(rate / share) + c * np.log((1 - rate) / (1 - share)), 0)
        for k in np.argsort(-gain * prefer)[:50]:
            own = word_ids[entry_ids == k]
            if gain[k] >= 8 and len(set().union(*(texts.get(words[i], ()) for i in own))) >= max(3, least_share * n_toxic):
                break
        else:
            break
        if gain[k] < 8:
            break
        out[entries[k]] = float(np.log(rate[k] / (1 - rate[k]) * (1 - share) / share))
        toxic[own] = clean[own] = 0
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    """Logistic regression by Newton steps; x gets a constant in front."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5000, longest: int = 65_536) -> Grammar:
    rows = training_rows(docs, labels, sample, longest)
    y = np.array([y for _, y in rows], float)
    if len(set(y)) < 2:
        return Grammar()
    learned = learn_lexicon(rows)
    g = Grammar(dict.fromkeys((w for w in INSULTS if not any(w.startswith(k[:-1]) for k in learned if k[-1] == "*")), BUILT_IN) | learned)
    f = np.array([g.features(t) for t, _ in rows])
    return Grammar(g.weights, fit_curve(np.column_stack([np.log1p(f[:, 0]), np.log1p(f[:, 1]), f[:, 2]]), y))


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""

    def run(batches):
        for b in batches:
            s = [grammar.score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([grammar.score(t) < threshold for t in b["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
