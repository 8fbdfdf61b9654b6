"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import quality, queries
from tesserae.llm.tokenization import Encoder, public_path
from tests.llm.test_mixing import plain_targets
from tests.llm.test_texts import SECRETS, near_sets, plain_near
from tests.oracle import DATA, same


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, tmp_path, empty):
    """Empty tables; nulls, repeated rows, a very long text and columns of clashing names, which all come along."""
    long = " ".join(f"tok{k % 5003}x{k}" for k in range(60_000))
    rows = [(1, long, "a"), (2, None, None), (3, "", "b"), (None, "no id " * 3 + long[:4000], "a"), (4, long[9000:15_000], None), (4, long[9000:15_000], None), (5, f"password = aB3dE5gH7jK9mN1p {long[20_000:26_000]}", "b")]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", "1 AS key", "2 AS hash", "3 AS label", "4 AS row", "5 AS draw", "6 AS n_rows", "7 AS kept")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if not empty and k == 2:
            kept = docs.collect()
            assert {r.doc_id for r in kept} == {1, None, 4, 5} and len(kept) == 4
            assert "aB3dE5gH7jK9mN1p" not in next(r.text for r in kept if r.doc_id == 5) and all(r.n_chars == len(r.text) for r in kept)
    assert (docs.count() == 0) == empty


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    prose = " ".join(f"tok{k}" for k in range(40))
    rows = near_sets()[:200] + [(1000 + k, f"{prose} nr{k} {t}") for k, t in enumerate(SECRETS)] + [(2000, "junk### " * 50), (2001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src' || (doc_id % 4) AS source", "length(text) AS n_chars")
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert kept[-1].columns == docs.columns
    base, good, single, masked, mixed, packed = ([r.asDict() for r in x.collect()] for x in kept)
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in base if not any(rule.rejects(quality.Document((r["text"] or "").encode())) for rule in quality.RULES))
    near = plain_near([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted({key for key, _, least in near if key == least})
    assert sorted(r["doc_id"] for r in masked) == sorted(r["doc_id"] for r in single)
    before, after = {r["doc_id"]: r["text"] for r in single}, {r["doc_id"]: r["text"] for r in masked}
    changed = {k for k in before if before[k] != after[k]}
    assert changed and all(k >= 1000 for k in changed) and "hunter2" not in "".join(after.values())
    times = Counter(r["doc_id"] for r in mixed)
    assert {r["text"] == after[r["doc_id"]] for r in mixed} == {True} and max(times.values()) <= 3
    size, taken = Counter(), Counter()
    for r in masked:
        n = len(r["text"].encode().split())
        size[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
    names = sorted(size)
    goal = plain_targets([size[n] for n in names], [[1, 2, 3][k % 3] for k in range(len(names))])
    assert all(abs(taken[n] - g) <= 5 for n, g in zip(names, goal))
    e, want = Encoder(public_path("byte_bpe_50k.json"), "byte"), Counter()
    for r in mixed:
        want[r["doc_id"]] += len(e.whole(r["text"])) // 2 + 1
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
        ids = np.frombuffer(e.whole(after[r["doc_id"]]), "<u2").tolist() + [0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]]
    assert got == want


def test_quality_stage_rejects_word_stutter(spark):
    prose = " ".join(f"word{k}" for k in range(40))
    stutter = " ".join(f"{w} " * n for w, n in (("This", 5), ("thhant", 8), ("quick", 7), ("This", 6), ("fox", 8)))
    rows = [(1, prose), (2, stutter), (3, prose + " had had that that"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src' AS source", "length(text) AS n_chars")
    assert quality.repeated_words(stutter.encode().split()) == 0
    assert sorted(r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == [1, 3]


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
