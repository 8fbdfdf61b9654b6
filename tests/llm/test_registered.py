"""The registered queries that SQL can't express, over one small folder, against brute force and the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tesserae.llm import queries, tokencount
from tesserae.llm.tokenization import public_path
from tests.llm.test_mixing import plain_targets
from tests.llm.test_texts import SECRETS, WORDS, best_split, frame, near_sets, plain_spans, texts

ROWS = [(k, t) for k, t in enumerate([*texts(), *SECRETS, "long words " * 20_000, *(t for _, t in near_sets()[:60])])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registered"))
    frame(spark, ROWS).repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32)).astype(np.float32)
    for k in range(150, 300):  # copies, close pairs and a chain
        x[k] = x[k - 150] if k < 170 else x[k - 150] * 2 + 0.1 * rng.normal(size=32) if k < 250 else x[k - 1] + 0.2 * rng.normal(size=32)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 32, 0), (302, [float("nan")] * 32, 0), (303, [None] + [1.0] * 31, 0), (304, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def encoded(name, end):
    tok = Tokenizer.from_file(public_path(name))
    return {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in ROWS}


def test_op2(spark, folder):
    model = tokencount.Unigram.from_sentencepiece(public_path("piece_bpe_32k.model"))
    memo = {}
    got = queries.QUERIES["op2_token_counts"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in ROWS]
    for r in got:
        words = [tokencount.MARK + w for w in WORDS.findall(ROWS[r.doc_id][1] or "")]
        memo |= {w: best_split(model, w) for w in words if w not in memo}
        assert (r.n_words, r.n_tokens, r.score) == (len(words), sum(memo[w][0] for w in words), sum(memo[w][1] for w in words))


def test_op3(spark, folder):
    ids, at = encoded("word_bpe_49k.json", 2), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op3_token_ids"](spark, folder).collect()}
    for k, _ in ROWS:
        assert got.pop(k) == (at, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        at += len(ids[k])
    assert not got


def test_op4(spark, folder):
    size = {k: len(WORDS.findall(t or "")) for k, t in ROWS}
    own = [sum(n for k, n in size.items() if k % 3 == s) for s in range(3)]
    goal = plain_targets(own, [1, 2, 3])
    got, taken = queries.QUERIES["op4_source_mix"](spark, folder).collect(), [0, 0, 0]
    assert sorted(r.doc_id for r in got) == [k for k, _ in ROWS]
    for r in got:
        s = r.doc_id % 3
        assert (r.size, r.source_size) == (size[r.doc_id], own[s]) and r.target == pytest.approx(goal[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    long = max(size.values())
    assert all(abs(t - g) <= (long if long in (size[k] for k in size if k % 3 == s) else 60) for s, (t, g) in enumerate(zip(taken, goal)))


def test_op5(spark, folder):
    """No link that all pairs in SQL lack, at least 0.95 of them, and the same rows without links."""
    import duckdb

    sql = queries.ORACLE_SQL["op5_embedding_dedup"].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({sql})").fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op5_embedding_dedup"](spark, folder).collect()}
    assert {*got} == {*want} and all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, *_ in got.values()) >= 0.95 * sum(n for n, *_ in want.values()) > 1000
    assert all(want[k][1] == want[c][1] and kept == (c == k) for k, (_, c, kept) in got.items())
    assert all(got[k] == want[k] == (0, k, True) for k in range(300, 305)) and all(got[k][1] == k - 150 for k in range(150, 170))


def test_op7(spark, folder):
    got = queries.QUERIES["op7_secret_scan"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in ROWS]
    for r in got:
        base = plain_spans(ROWS[r.doc_id][1])
        listed = [f"{k}:{s}:{e}" for s, k, e in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert {*listed} <= {*r.spans.split(",")} and all(x.startswith("generic:") for x in {*r.spans.split(",")} - {*listed, ""})


def test_op9(spark, folder):
    ids = encoded("byte_bpe_50k.json", 0)
    got, fill, covered = queries.QUERIES["op9_packing"](spark, folder).collect(), {}, dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.length > 0
        fill[r.sequence_id] = r.offset + r.length
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert (r.start, r.doc_tokens) == (covered[r.doc_id], len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
    assert covered == {k: len(v) for k, v in ids.items()} and max(fill.values()) <= 1024
    assert sum(v < 1024 - 32 for v in fill.values()) <= 8
