"""Hard negatives against all products."""

import math

import numpy as np
import pytest

from tesserae.llm import hard_negatives, queries
from tests.oracle import same


def rows_of(n=700, dims=24, hot=False, scale=1.0, labels=4):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) / math.sqrt(dims) * scale
    for k in range(n // 2, n):  # near and exact copies
        x[k] = x[k % 60] if k % 3 else 0.9 * x[k % 60] + 0.1 * rng.normal(size=dims) / math.sqrt(dims) * scale
    if hot:
        x[: n // 2] = x[1]
    return [(k, x[k].astype(np.float32).tolist(), int(0 if hot else rng.integers(labels))) for k in range(n)]


ODD = [(None, [1.0] * 24, 1), (2000, None, 1), (2001, [float("nan")] * 24, 1), (2050, [None] + [1.0] * 23, 1), (2100, [float("inf")] * 24, 2), (2150, [0.1] * 24, None), (2200, [0.1] * 5, 1), (2250, [0.2] * 5, 1), (2251, [0.1] * 5, 2), (2300, [], 1), (2301, [], 1), (2302, [], 2), (2350, [3e30] * 24, 1), (-50, [0.3] * 24, 1), (-7, [0.3] * 24, 9), (2400, [0.0] * 24, 3)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 AS id", "2 AS q", "3 AS score", "4 AS kind", "5 AS low", "6 AS p").repartition(3)


def plain(rows, every=50, n_pos=5, n_neg=3, low=50, high=95):
    found = {}
    for key, v, label in rows:
        if key is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) >= 1 << 62:
            continue
        if key % 7 == 0:
            label = (label + 1) % 10
        found[key] = min(found.get(key, (label, q)), (label, q))
    out = []
    for a, (la, qa) in found.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(qa, q)), k, lk) for k, (lk, q) in found.items() if k != a and len(q) == len(qa))
        for s, k, _ in [x for x in scores if x[2] == la][:n_pos]:
            fits = [(t, j) for t, j, lj in scores if lj != la and low * -s <= 100 * -t <= high * -s][:n_neg]
            out += [(a, k, r, j, -s, -t) for r, (t, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("hot", "scale", "group", "batch"), [(False, 1.0, 1024, 1024), (True, 1.0, 3, 50), (False, 300.0, 5, 64), (False, 2e5, 1024, 100), (False, 1e7, 1024, 1024)])
def test_all_products(spark, monkeypatch, hot, scale, group, batch):
    """Small groups and batches; float32, float64 and integer sums; a hot vector and label."""
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "BATCH", batch)
    rows = rows_of(hot=hot, scale=scale) + (ODD + [(100, [0.01] * 24, 0), (100, [0.02] * 24, 0)] if scale == 1 else [])
    got = sorted(map(tuple, hard_negatives.hard_negatives(frame(spark, rows)).collect()))
    assert got == plain(rows) and got


def test_other_parameters(spark):
    rows = rows_of(300)
    got = hard_negatives.hard_negatives(frame(spark, rows), every=20, n_positives=2, n_negatives=7, low=10, high=80)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20, 2, 7, 10, 80)


def test_pairs_are_dropped_early(monkeypatch):
    """Most pairs end before their last plane."""
    rng = np.random.default_rng(1)
    q = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    s = hard_negatives.Search(np.arange(50), np.zeros(50, np.int64), q[:50], np.full((50, 1), -(1 << 61)), np.full((50, 1), 1 << 61), 5, True)
    held = []
    finish = s._finish
    monkeypatch.setattr(s, "_finish", lambda *a: held.append((a[3], np.count_nonzero(a[1]) / a[1].size)) or finish(*a))
    for at in range(0, 3000, 500):
        s.add(np.arange(at, at + 500), np.zeros(500, np.int64), q[at : at + 500].astype(np.int32))
    assert len(held) >= 4 and all(b >= 2 and share <= 1 / 16 for b, share in held[1:])
    want = q[:50] @ q.T
    for a in range(50):
        order = sorted(((-want[a, k], k) for k in range(3000) if k != a))[:5]
        assert [(-x, k) for x, k in zip(s.best.scores[a].tolist(), s.best.ids[a].tolist())] == order


def test_empty(spark):
    assert hard_negatives.hard_negatives(frame(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, [(50, [1.0], 1)])).count() == 0


def test_op13(spark):
    same(spark, queries.QUERIES["op13_hard_negatives"], queries.ORACLE_SQL["op13_hard_negatives"])

