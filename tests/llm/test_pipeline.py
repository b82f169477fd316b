"""The corpus pipeline in a row, on a small table with everything odd in it."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gavelflow.llm import line_dedup
from gavelflow.llm.common import cut
from gavelflow.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, h string, rank int, `__x` string, _gf string"
VOCAB = [f"w{i}" for i in range(300)]


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(11), [], []
    for i in range(240):
        w = words(rng, rng.randint(30, 90)).split()
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "idiot", "scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    base, passage = words(rng, 120), words(rng, 55)
    near = base.split()
    near[60] = "changed"
    rows += [(300, base), (301, base), (302, " ".join(near)), (303, "top\n" + passage + "\nend"), (304, "other\n" + passage + "\nlast"), (305, "a b\nc d\ne"), (306, "x\na b\nc d\ny"), (307, None), (308, ""), (309, "  \n "), (310, words(rng, 9000)), (311, "?!"), (300, base), (None, words(rng, 40)), (None, None)]
    top = tmp_path_factory.mktemp("pipeline")
    table = spark.createDataFrame([(i, t, None, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}", 1, 5, "h", 2, "x", "g") for i, t in rows], SCHEMA)
    table.repartition(3).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), rows, dict(labels)


def bag(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, path))
        assert out.columns == docs.columns, name
        after[name] = docs = out
    kept = bag(after["toxicity"])
    assert sum(kept.values()) == sum(not toxic.get(i, 0) for i, _ in rows)
    assert all(not toxic.get(i, 0) for i, _ in kept)
    lines = bag(after["line dedup"])
    assert sum(lines.values()) == sum(kept.values())
    texts = {i: t for i, t in lines if i is not None}
    assert texts[303].count("\n") == 2 and texts[304] == "other\nlast" and texts[305] == "a b\nc d\ne" and texts[306] == "x\ny" and texts[307] is None
    near = bag(after["near dedup"])
    ids = {i for i, _ in near}
    assert 300 in ids and 301 not in ids and 302 not in ids and set(near.values()) == {1} and set(near) <= set(lines)
    clean = {i for i, t in rows if i is not None and i < 240 and not toxic[i]}
    assert clean <= ids and {303, 304, 305, 306, 310, None} <= ids
    mixed = bag(after["mixing"])
    assert set(mixed) == set(near)
    sources = {r["doc_id"]: r["source"] for r in after["mixing"].select("doc_id", "source").collect()}
    for s in set(sources.values()):
        times = [n for (i, t), n in mixed.items() if sources[i] == s and (t or "").split()]
        assert not times or max(times) - min(times) <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    check_packed(packed, mixed)


def check_packed(packed, mixed):
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(vocabulary()), collections.Counter()
    for (i, t), n in mixed.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))] += n
    assert collections.Counter(tuple(r)[:5] for r in packed) == want
    end = collections.Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert max(end.values()) <= 2048


def test_run(spark, folder):
    path, rows, toxic = folder
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} >= {i for i, _ in rows if i is not None and i < 240 and not toxic[i]}
    assert not {r["doc_id"] for r in packed} & {i for i, y in toxic.items() if y}


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages(spark):
    """A line of over 50 words goes wherever it stands again, one of 50 stays; later copies only."""
    rng = random.Random(1)
    long, short = words(rng, 51), words(rng, 50)
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{long}"), (3, long), (4, f"e\n{short}"), (5, f"f\n{short}\ng"), (6, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.clean(d, passage_words=50).collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 3: "", 4: rows[3][1], 5: rows[4][1], 6: None}
    assert {r["doc_id"]: r["n_deleted"] for r in line_dedup.report(d, passage_words=50).collect()} == {1: 0, 2: 2, 3: 1, 4: 0, 5: 0, 6: 0}
