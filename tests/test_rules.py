"""Rules of the engine against plain Python: statements put wrong, long documents, generated tasks, records, ranks, checks."""

import collections
import datetime
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gavelflow import registry
from gavelflow.__main__ import main
from gavelflow.operators import clean, committee, decontam, evaluate, mutate, packing, ranks, records, sample, typed
from gavelflow.operators.salvage import salvaged

SF = "/root/testdata/sf0.001"


def draw(x, n):
    return int(hashlib.md5(x.encode()).hexdigest()[:7], 16) % n


def corrupted(x, key):
    m = re.search(r"\b(\d+)\b", x, re.A)
    if m and len(m[1]) <= 30:
        return x[: m.start()] + str(int(m[1]) + [5, 10, 100][draw(key, 3)]) + x[m.end() :]
    for a, b in mutate.ANTONYMS:
        if re.search(rf"\b{a}\b", x, re.I):
            return re.sub(rf"\b{a}\b", b, x, count=1, flags=re.I)
    return mutate.DENIED + x[:1].lower() + x[1:]


TEXTS = [
    "It costs 5 units and 7 more", "Sales INCREASED in May and increased in June", "Cats sleep", "12 at the start", "They left before noon", "", "A1 is 3rd of 44", "Growth of 12 % and 40% in Dublin", "It cost $12.50 million in 1999", "Nothing here", "In 2021 more firms grew", "Mars has 2 moons and Earth 1",
    "Profits fell short of 30 goals", "$3 thousand", "1987", "The majority supported it in Tokyo", "x 100% y 5% z 33%", "9 lives", "1" * 40,
]


def test_corrupted(spark):
    got = spark.createDataFrame(list(enumerate(TEXTS)), "id int, x string").select("id", mutate.corrupted(F.col("x"), F.concat(F.lit("k"), "id")).alias("y")).collect()
    assert {r["id"]: r["y"] for r in got} == {i: corrupted(x, f"k{i}") for i, x in enumerate(TEXTS)}


def plain(x):
    return str(int(x)) if x == int(x) else str(x)


KINDS = [
    (r"\b\d{1,15}\s*%", lambda m: f"{max(1, int(re.match(r'\d+', m)[0]) - 10) if int(re.match(r'\d+', m)[0]) > 15 else int(re.match(r'\d+', m)[0]) + 35}%"),
    (r"\$\d{1,15}(?:\.\d+)?(?:\s*(?:billion|million|thousand))?", lambda m: (lambda v, u: "$" + plain(round(v / 2, 1) if v > 5 else round(v * 4, 1)) + (f" {u}" if u else ""))(float(re.match(r"\$([\d.]+)", m)[1]), (re.search(r"(billion|million|thousand)$", m, re.I) or [""])[0])),
    (r"\b(?:19\d{2}|20\d{2})\b", lambda m: str(int(m) - 3 if int(m) >= 2020 else int(m) + 5)), (r"\b\d{2,15}\b", lambda m: str(int(m) // 3 if int(m) > 30 else int(m) * 3)),
]


def turned(x, key):
    def number():
        for pattern, by in KINDS:
            found = list(re.finditer(pattern, x, re.I))
            if found:
                m = found[draw(f"{key}:number", len(found))]
                return x[: m.start()] + by(m[0]) + x[m.end() :]

    def swap(pairs):
        fit = [p for p in pairs if re.search(rf"\b{p[0]}\b", x, re.I)]
        if fit:
            a, b = fit[draw(f"{key}:swap", len(fit))]
            return re.sub(rf"\b{a}\b", b, x, count=1, flags=re.I)

    made = {"number": number(), "polarity": swap(mutate.POLARITY), "name": swap(mutate.NAMES)}
    axes = list(made)
    orders = [(a, b, c) for a in axes for b in axes for c in axes if len({a, b, c}) == 3]
    return next(((a, made[a]) for a in orders[draw(f"{key}:axis", 6)] if made[a] not in (None, x)), None)


def test_counterfactual(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, x string")
    got = {r["id"]: (r["axis"], r["flipped"]) for r in mutate.counterfactual(d, "x", F.concat(F.lit("k"), "id")).collect()}
    want = {i: t for i, x in enumerate(TEXTS) if (t := turned(x, f"k{i}"))}
    assert got == want and {a for a, _ in want.values()} == {"number", "polarity", "name"}


@pytest.mark.parametrize("few, many, drop, corrupt", [(8, 25, 0.3, 0.6), (15, 40, 0.3, 0.0), (2, 3, 0.0, 0.0)])
def test_haystack(spark, few, many, drop, corrupt):
    """A row for every statement: left out, put wrong or whole, at its place among as many others as drawn."""
    fillers = [f"filler {k} of the pool" for k in range(30)]
    rows = [(i, TEXTS[i % len(TEXTS)] + f" of case {i}", i % 3) for i in range(200)]
    got = {r["id"]: r for r in mutate.haystack(spark.createDataFrame(rows, "id int, premise string, label int"), spark.createDataFrame([(fillers,)], "fillers array<string>"), few, many, drop, corrupt).collect()}
    kinds = collections.Counter()
    for i, premise, label in rows:
        key = f"hay:{i}"
        roll, n, start = draw(f"{key}:roll", 1000) / 1000, min(30, few + draw(f"{key}:n", many - few + 1)), draw(f"{key}:start", 30)
        doc = [fillers[(start + k) % 30] for k in range(n)]
        if roll < drop:
            kind, y = "drop", 2
        elif roll < corrupt and label == 1:
            kind, y = "corrupt", 0
        elif label == 0 and corrupt > drop:
            kind, y = "drop", 2
        else:
            kind, y = "embed", label
        if kind != "drop":
            doc.insert(draw(f"{key}:place", n + 1), corrupted(premise, key) if kind == "corrupt" else premise)
        assert tuple(got[i]) == (i, y, kind, len(doc), "\n\n".join(doc))
        kinds[kind] += 1
    assert set(kinds) == ({"embed"} if not drop else {"drop", "corrupt", "embed"} if corrupt else {"drop", "embed"})


def test_haystacks_cover_all_documents(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for name in ("haystack", "haystack_simple"):
        assert {r[0] for r in registry.QUERIES[name](spark, SF).select("id").collect()} == ids


def options(r):
    return {k.upper(): r[k] for k in "abcd"}


def test_deadlines(spark):
    """Business hours counted minute by minute."""
    for r in registry.QUERIES["gen_sla_deadline"](spark, SF).collect():
        m = re.match(r"Ticket \d+ was opened on (\w+), (\w+ \d+) at (\d+:\d+) UTC and is due after (\d+) business hours", r["state"])
        at, left = datetime.datetime.strptime(f"2026 {m[2]} {m[3]}", "%Y %B %d %H:%M"), int(m[4]) * 60
        assert at.strftime("%A") == m[1]
        while left:
            if at.weekday() < 5 and 9 <= at.hour < 17:
                left -= 1
            at += datetime.timedelta(minutes=1)
        assert options(r)[r["gold"]] == at.strftime("%A, %B %d at %H:%M UTC") and len(set(options(r).values())) == 4, r


def test_generated_sums(spark):
    for r in registry.QUERIES["gen_tiered_pricing"](spark, SF).collect():
        t1, r1, t2, r2, r3, used = map(int, re.findall(r"\d+", r["state"]))
        assert options(r)[r["gold"]] == f"${(t1 * r1 + (t2 - t1) * r2 + (used - t2) * r3) / 100:,.2f}"
    for r in registry.QUERIES["gen_bayes"](spark, SF).collect():
        p, s, f = (int(x) / 100 for x in re.findall(r"\d+", r["state"]))
        assert options(r)[r["gold"]] == f"{100 * s * p / (s * p + f * (1 - p)):.1f}%"
    for r in registry.QUERIES["gen_emv"](spark, SF).collect():
        up, flat, ca, a1, a2, a3, cb, b1, b2, b3 = map(int, re.findall(r"-?\d+", r["state"]))
        a, b = ((up * x + flat * y + (100 - up - flat) * z) / 100 - c for x, y, z, c in ((a1, a2, a3, ca), (b1, b2, b3, cb)))
        assert options(r)[r["gold"]] == f"Select Option {'A' if a > b else 'B'} (Net Expected Value: ${max(a, b):,.0f})"
    for r in registry.QUERIES["gen_timezone_span"](spark, SF).collect():
        zones = {"PST": -8, "EST": -5, "GMT": 0, "JST": 9, "AEDT": 11}
        times = [datetime.datetime.strptime(f"2026 {d} {t}", "%Y %B %d %H:%M") - datetime.timedelta(hours=zones[z]) for d, t, z in re.findall(r", (\w+ \d+) at (\d+:\d+) UTC less its offset, in (\w+)", r["state"])]
        span = int((times[-1] - times[0]).total_seconds() // 60)
        assert len(times) == 4 and options(r)[r["gold"]] == f"{span // 60} hours and {span % 60} minutes"
    for r in registry.QUERIES["gen_long_doc"](spark, SF).collect():
        sub, ded, claim = (int(x.replace(",", "")) for x in re.search(r"Tier-1 insured\): sublimit \$([\d,]+), deductible \$([\d,]+)\..*?Claim \d+: \$([\d,]+),", r["state"]).groups())
        assert options(r)[r["gold"]].startswith(f"Pay ${min(claim, sub) - ded:,} under the rider with")
    for name, shares in (("mode_tool_routing", 3), ("gen_p4_ambiguous", 3), ("gen_p4_tradeoff", 4), ("gen_p4_long_policy", 4)):
        rows = registry.QUERIES[name](spark, SF).collect()
        assert all(n == shares for n in collections.Counter(r["group_id"] for r in rows).values()), name
    for name in ("gen_routing", "gen_judge_hard", "gen_policy", "gen_tradeoff"):
        rows = registry.QUERIES[name](spark, SF).collect()
        groups = collections.defaultdict(list)
        for r in rows:
            groups[r["group_id"]].append(r["label"])
        assert len(groups) == 200 and all(sum(g) == 1 and 2 <= len(g) <= 4 for g in groups.values()), name


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([1.0, 2.0, 2.0, 5.5, rng.random()]), rng.randrange(9)) for i in range(500)]
    d = spark.createDataFrame([*rows, (500, None, 0.5, 3)], "id int, g string, x double, w int")
    got = {r["id"]: r for r in ranks.ranked(d, ranks.by_value(d, "x", 16), ["x", "id"], by=["g"], value=F.col("w"), before="before", size="n", total="t").collect()}
    for g in ("a", "b", None):
        own = sorted((x, i, w) for i, h, x, w in [*rows, (500, None, 0.5, 3)] if h == g)
        at = 0
        for k, (x, i, w) in enumerate(own, 1):
            assert (got[i]["rank"], got[i]["before"], got[i]["n"], got[i]["t"]) == (k, at, len(own), sum(v for _, _, v in own))
            at += w
    falling = ranks.ranked(d, ranks.by_value(d, "x", 16, falling=True), [F.desc("x"), "id"]).orderBy("rank").collect()
    assert [r["id"] for r in falling] == [i for _, i in sorted((-x, i) for i, _, x, _ in [*rows, (500, None, 0.5, 3)])]
    assert ranks.ranked(d.limit(0), ranks.by_value(d.limit(0), "x"), ["x"]).count() == 0


def test_samples(spark):
    rows = [(i, "abc"[i % 3] if i % 10 else None, i % 4 + 1) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, g string, w int")
    place = lambda i, seed=42: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    by = lambda g: sorted((i for i, h, _ in rows if h == g), key=place)
    everything = sorted((i for i, _, _ in rows), key=place)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(sample.take(d, "id", 17)) == set(everything[:17])
    assert ids(sample.balanced(d, "g", "id", 40, 4)) == {i for g in ("a", "b", "c", None) for i in by(g)[:10]}
    least = min(len(by(g)) for g in ("a", "b", "c", None))
    assert ids(sample.balance_to_least(d, "g", "id", 1.5)) == {i for g in ("a", "b", "c", None) for i in by(g)[: int(1.5 * least)]}
    assert ids(sample.split(d, "id", 0.1, by=["g"]).where("part = 'val'")) == {i for g in ("a", "b", "c", None) for i in by(g)[: max(1, len(by(g)) // 10)]}
    assert ids(sample.split(d, "id", 0.05).where("part = 'val'")) == set(everything[:10])
    for crossing in (True, False):
        at, want = 0, set()
        for i in everything:
            at += i % 4 + 1
            if (at - (i % 4 + 1) < 50) if crossing else at <= 50:
                want.add(i)
        assert ids(sample.budget(d, "w", "id", 50, crossing)) == want
    assert ids(sample.cap(d, ["g"], [F.desc("id")], 2)) == {i for g in ("a", "b", "c", None) for i in sorted(by(g))[-2:]}
    assert sample.oversample(d, "id", F.col("g") == "a", 3).count() == 200 + 2 * len(by("a"))
    assert sample.take(d.limit(0), "id", 5).count() == 0 and sample.split(d.limit(0), "id", 0.1).count() == 0


def test_checks_raise(spark):
    used, banned = spark.createDataFrame([("x", "test"), ("y", "train"), ("z", "a")], "repo string, split string"), spark.createDataFrame([("x", "train"), ("q", "*")], "repo string, split string")
    assert clean.assert_allowed(used, banned).count() == 3
    with pytest.raises(ValueError, match="y/train"):
        clean.assert_allowed(used, spark.createDataFrame([("y", "*")], "repo string, split string"))
    d = spark.createDataFrame([(1,), (1,), (2,), (None,)], "label int")
    assert clean.assert_min(d, "label", {1: 2}).count() == 4
    with pytest.raises(ValueError, match="2: 1"):
        clean.assert_min(d, "label", {1: 2, 2: 5})
    with pytest.raises(ValueError, match="2 rows"):
        clean.assert_domain(d, "label", [1])
    with pytest.raises(ValueError):
        clean.purge_non_ok(d)


def test_split_hygiene(spark):
    """Copies within train, in both parts, and a picture that tells equal texts apart."""
    train = spark.createDataFrame([(1, "A  b", "c", ""), (2, "a B", "C", ""), (3, "a b", "c", "p.png"), (4, "x", "y", None)], "ord int, premise string, hypothesis string, image string")
    val = spark.createDataFrame([(5, "a b", "c", ""), (6, "new", "n", ""), (7, "NEW", "n", ""), (8, "x", "y", "")], "ord int, premise string, hypothesis string, image string")
    got = {r["ord"]: (r["part"], r["kept"]) for r in clean.dedupe_split(train, val, "ord", clean.pair_key(image="image")).collect()}
    assert got == {1: ("train", True), 2: ("train", False), 3: ("train", True), 4: ("train", True), 5: ("val", False), 6: ("val", True), 7: ("val", False), 8: ("val", False)}


def test_decontaminate(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(14)))) for i in range(300)] + [(300, None), (301, "")]
    tests = [(i, " ".join(rng.choice("abc") for _ in range(8))) for i in range(4)]
    grams = lambda t, n=6: {tuple(t.split()[j : j + n]) for j in range(len((t or "").split()) - n + 1)} if t else set()
    bad = set().union(*(grams(t) for _, t in tests))
    d, t = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(tests, "k int, text string")
    got = {r["id"] for r in decontam.decontaminate(d, "id", t, decontam.ws_words, 6).collect()}
    assert got == {i for i, x in docs if not grams(x) & bad} and len(got) < len(docs)
    best = {r["k"]: (r["id"], r["shared"], r["jaccard"]) for r in decontam.overlap(t, d, "k", "id", decontam.ws_words, 3, False).collect()}
    for k, x in tests:
        a = grams(x, 3)
        shared, neg = max((len(a & grams(y, 3)), -i) for i, y in docs)
        b = grams(dict(docs)[-neg], 3)
        assert best.get(k) == ((-neg, shared, round(shared / len(a | b), 6)) if shared else None)


def test_records_at_the_edges(spark):
    d = spark.createDataFrame([(0, None), (1, ""), (2, "null"), (3, "3"), (4, '{"context": "c", "endings": ["a", null], "label": 1}')], "index int, record string")
    got = records.candidates(d, "x", records.holdings()).collect()
    assert [(r["group_id"], r["hypothesis"], r["label"]) for r in got] == [("x_train_4", "The correct answer is: a", 0), ("x_train_4", "The correct answer is: ", 1)]
    for make in (records.reading, records.reasoning, records.logic, records.abstracts, records.commonsense, records.puzzles, records.strategies, records.algebra, records.science, records.subjects):
        assert records.candidates(d.where("index < 4"), "x", make()).count() == 0
    assert records.candidates(d.limit(0), "x", records.reading()).count() == 0
    assert [r["problem"] for r in records.decisions(d.where("index < 4")).collect()] == ["number of options"] * 4
    whole = records.decisions(spark.createDataFrame([(0, '{"id": "d", "options": ["p", "q", "r"], "gold_index": 2, "soft_distribution": [0.1, 0.2, 0.7]}')], "index int, record string"))
    turns = {r["id"]: ([o["text"] for o in r["options"]], [o["key"] for o in r["options"]], r["gold_index"], r["soft_distribution"]) for r in records.rotations(whole).collect()}
    assert turns == {"d_perm_0": (["p", "q", "r"], ["A", "B", "C"], 2, [0.1, 0.2, 0.7]), "d_perm_1": (["q", "r", "p"], ["A", "B", "C"], 1, [0.2, 0.7, 0.1]), "d_perm_2": (["r", "p", "q"], ["A", "B", "C"], 0, [0.7, 0.1, 0.2])}


def test_typed_at_the_edges(spark):
    cases = spark.createDataFrame([("a", "d", "s", '{"q": {"type": "noul", "instructions": " I? "}, "r": {"type": "choice", "instructions": "C?", "criteria": {"x": "1", "y": "2", "z": "3", "w": "4"}}, "t": {"type": "score", "instructions": "S?", "criteria": ["l", "m"]}, "u": {"type": "noul", "instructions": ""}}', '{"q": false, "r": "y", "t": "1"}', '{"q": {"noul": 1.7}, "r": {"probabilities": {"w": 0.3}}}'), ("b", "d", "s", "{broken", "{}", "{}"), ("c", None, None, None, None, None)], "state_id string, domain string, state string, questions string, gold string, teacher string")
    q = typed.questions(cases)
    assert {(r["option"], r["label"], r["soft_target"]) for r in typed.noul(q).collect()} == {("yes", 0, 1.0), ("no", 1, 0.0)}
    assert {(r["option"], r["label"], round(r["soft_target"], 4)) for r in typed.choice(q).collect()} == {("x", 0, 0.0167), ("y", 1, 0.95), ("z", 0, 0.0167), ("w", 0, 0.3)}
    assert [r["option"] for r in typed.choice(q, grouped=False).orderBy("option").collect()] == ["w", "x", "y"]
    assert {(r["option"], r["label"]) for r in typed.score(q, grouped=False).collect()} == {("0", 0), ("1", 1)}
    assert typed.ingest(cases).count() == 8


def test_salvage():
    assert salvaged(None) == [] and salvaged("[") == [] and salvaged('{"data": [{"premise": "a"}, {"premise": "b"') == [{"premise": "a"}]
    assert salvaged("```\n{'samples': [{'a': 1}]}\n```") == [{"a": 1}]


def test_paired_errors(spark):
    """Exact under 25 discordant items, else chi-square with the continuity correction."""
    for r in registry.QUERIES["mcnemar_mixed"](spark, "/root/testdata/sf0.1").collect():
        b, c = r["b"], r["c"]
        n, low = b + c, min(b, c)
        p = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n < 25 else math.erfc(math.sqrt(max(0, abs(b - c) - 1) ** 2 / n / 2))
        assert math.isclose(r["p"], p, abs_tol=2e-6)


def test_temperature(spark):
    rng = random.Random(3)
    rows = [tuple([*(z := [rng.gauss(0, 3) for _ in range(3)]), max(range(3), key=lambda k: z[k] / 2.5 - math.log(-math.log(rng.random())))]) for _ in range(3000)]
    got = packing.temperature_fit(spark.createDataFrame(rows, "z0 double, z1 double, z2 double, gold int")).collect()[0]
    nll = lambda t: sum(math.log(sum(math.exp(x / t) for x in r[:3])) - r[r[3]] / t for r in rows) / len(rows)
    best = min((nll(t / 100), t / 100) for t in range(100, 500))
    assert abs(got["t"] - best[1]) < 0.05 and math.isclose(got["nll"], nll(got["t"]), abs_tol=1e-4)


def test_pack_single_rows(spark):
    """Rows that say they are in no group are units of their own."""
    rows = [("g", 0, 5), ("g", 1, 3), (None, 2, 4), ("-1", 3, 4), ("", 4, 2), ("-1", 5, 90)]
    out = packing.group_pack(spark.createDataFrame(rows, "g string, o long, n int"), "g", "o", "n", 10).collect()
    assert len(out) == 5 and sorted(r["first"] for r in out) == [0, 2, 3, 4, 5]
    batch = {r["first"]: r["batch"] for r in out}
    assert batch[5] == 0 and batch[0] == 1 and batch[2] == batch[3] == 2


def test_decisions_api(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("b", 0, 0.0)], "g string, o int, s double")
    top = {r["g"]: (r["o"], round(r["probability"], 6)) for r in evaluate.decide(d, "g", "s", "o").collect()}
    p = 1 / (2 + math.exp(-2))
    assert top == {"a": (1, round(p, 6)), "b": (0, 1.0)}
    assert [(r["o"], r["rank"]) for r in evaluate.rerank(d, "g", "s", "o").where("g = 'a'").orderBy("rank").collect()] == [(1, 1), (2, 2), (0, 3)]
    v = evaluate.judge(spark.createDataFrame([(0.2, 0.2, 0.1), (0.1, 0.5, 0.5), (0.0, 0.1, 0.9)], "p0 double, p1 double, p2 double"))
    assert [r["verdict"] for r in v.collect()] == ["contradiction", "entailment", "neutral"]
    assert {r["g"]: r["rating"] for r in evaluate.rate(d, "g", "o", "s").collect()} == {"a": 9 / 7}


def test_debias(spark):
    """A bias by position cancels out over all shifts."""
    own, bias = [0.1, 0.5, 0.4], [0.3, 0.0, -0.3]
    rows = [("q", s, p, 3, own[(p + s) % 3] + bias[p]) for s in range(3) for p in range(3)] + [("one", 0, 0, 1, 0.2)]
    d = spark.createDataFrame(rows, "g string, s int, p int, k int, x double")
    got = {(r["g"], r["slot"]): round(r["score"], 9) for r in evaluate.debias(d, "g", "s", "p", "k", "x").collect()}
    assert got == {("q", 0): 0.1, ("q", 1): 0.5, ("q", 2): 0.4, ("one", 0): 1.0}
    with pytest.raises(ValueError):
        evaluate.debias(d, "g", "s", "p", "k", "x", most=2)


def test_committee(spark):
    """Outcomes by hand: unanimous, split, tie, nobody, a single vote against, an override with and without all judges."""
    votes = [("a", 1, [1, 1, 1]), ("b", 1, [0, 0, 1]), ("c", 1, [0, 1, None]), ("d", 2, [None, None]), ("e", 1, [0, None]), ("f", 1, [2, 2, 2]), ("g", 2, [0, 0, None]), ("h", 0, [0, 0, None]), ("i", 2, [1, 1])]
    d = spark.createDataFrame([(s, g, v or 0, "offline" if v is None else "ok") for s, g, vs in votes for v in vs], "sample string, gen int, label int, status string")
    got = {r["sample"]: (r["final"], r["kind"], r["severity"], round(r["confidence"], 3)) for r in committee.resolve(committee.tally(d)).collect()}
    assert got == {
        "a": (1, "unanimous_consensus", "none", 1.0), "b": (0, "committee_split", "high", 0.667), "c": (1, "committee_split_tie", "high", 0.5), "d": (2, "no_judge_verdicts", "high", 0.0), "e": (1, "insufficient_quorum", "high", 1.0),
        "f": (2, "unanimous_label_override", "low", 1.0), "g": (0, "unanimous_label_override", "high", 0.667), "h": (0, "partial_committee_failure", "medium", 1.0), "i": (1, "unanimous_label_override", "medium", 1.0),
    }


def test_file_hashes(spark):
    with open(f"{SF}/region.parquet", "rb") as f:
        want = hashlib.sha256(f.read()).hexdigest()[:16]
    assert [tuple(r) for r in registry.QUERIES["file_sha"](spark, SF).collect()] == [("region.parquet", want)]


def test_command_line(spark, capsys, tmp_path):
    assert main(["list"]) == 0 and "accuracy" in capsys.readouterr().out.split()
    assert main(["sql", "accuracy"]) == 0 and main(["run", "no_such", "--data", SF]) == 2
    assert main(["run", "accuracy", "--data", SF, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 1
