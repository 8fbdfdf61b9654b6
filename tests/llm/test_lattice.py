import itertools

import numpy as np
import pytest

from tesserae.llm import lattice
from tesserae.llm._common import stored
from tesserae.llm.components import components


def brute(rows, cosine):
    """n_links and component by all pairs."""
    ok = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v)).all() and np.any(v)]
    out = {k: [0, k] for k in range(len(rows))}
    link = {k: set() for k in ok}
    for i, j in itertools.combinations(ok, 2):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
            link[i].add(j), link[j].add(i)
    for k in ok:
        seen, todo = {k}, [k]
        while todo:
            for m in link[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[k] = [len(link[k]), min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)]
    return {rows[k][0]: (n, c if k in link else rows[k][0]) for k, (n, c) in out.items()}


def test_decoder_finds_a_nearest_lattice_point():
    rng = np.random.default_rng(0)
    steps = lattice.e8_minimal()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    x = rng.normal(size=(500, 8)) * 3
    p = lattice.e8_nearest(x)
    doubled = 2 * p
    assert (doubled == np.rint(doubled)).all() and (np.ptp(doubled % 2, axis=1) == 0).all() and (p.sum(1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    assert (d <= ((x[:, None] - p[:, None] - steps) ** 2).sum(2).min(1) + 1e-9).all()


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    for k in range(150):  # near copies, chains and exact copies
        of = rows[rng.integers(len(rows))][1]
        rows.append((100 + k, (np.array(of) + rng.normal(size=16) * rng.choice([0, 0.02, 0.1])).tolist()))
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, None] * 8), (504, [float("nan")] * 16), (505, [float("inf")] * 16), (506, [1.0, 0.0]), (507, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS cid", "1 AS label")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()}
    assert got == brute(rows, 0.9)
    assert got[506] == (1, 506) and got[507] == (1, 506)


def test_split_cells_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 8)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [(k, (centre + rng.normal(size=8) * 0.01).tolist()) for k in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).where("vec_id > 0").collect()} == {(69, 0, False)}


@pytest.mark.parametrize("n", [1000, 1 << 20, 1 << 40])
def test_recall_at_the_threshold_itself(n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    tables, blocks, width = lattice.shape(n)
    cells = lattice.Lattice(64, tables, lattice.PROBES, blocks, width, 11)
    a, b = cells.codes(x), cells.codes(y)
    met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    differ = np.bitwise_count(cells.sketches(x) ^ cells.sketches(y)).sum(1)
    assert met.mean() > 0.95 and (differ <= lattice.sketch_limit(0.9)).all()
    c = cells.codes(np.roll(x, 1, 0))
    strangers = ((a == c[:, :, :1]) | (c == a[:, :, :1])).any((1, 2)).mean()
    assert strangers <= {8: 0.01, 26: 0.002, 36: 0.002}[tables]


@pytest.mark.parametrize("options", [{}, {"tables": 26, "blocks": 2, "width": 1.6}])
def test_recall_of_a_table_with_planted_pairs(spark, options):
    """Links found end to end, of all pairs at 0.9 and more by brute force."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(600, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x = np.concatenate([x, x[:600] + z * rng.uniform(0.1, 0.6, (600, 1))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in lattice.near_vectors(df, **options).orderBy("vec_id").collect()])
    assert want.sum() > 400 and (got <= want).all() and got.sum() >= 0.95 * want.sum()


def test_one_vector_in_most_rows(spark, monkeypatch):
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 else [float(k), 1.0, -1.0 - k]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 0.9)
    for share in (1 / 1024, 2.0):
        monkeypatch.setattr("tesserae.llm._common.HOT_SHARE", share)
        assert {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()} == want


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 200)] + [(500, 501)], []])
def test_components_of_chains_and_stars(spark, monkeypatch, links):
    rounds = []
    monkeypatch.setattr("tesserae.llm.components.stored", lambda df, kind: rounds.append(kind) or stored(df, kind))
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    groups = {}
    for node, label in got.items():
        groups.setdefault(label, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(([list(range(301))] if len(links) == 300 else [list(range(200)), [500, 501]]) if links else [])
    assert rounds.count("cc-parents") <= 8


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [5.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, lattice.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (3, 0, 3, True)], key=str)
