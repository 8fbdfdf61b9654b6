import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.functions import bounds, kernels, laws, metrics
from tesserae.functions.invariants import HYPERBOLICITY_DEFICIT, NAMED, PAIRWISE_DISTANCE, VR_PERSISTENCE_4_1, Invariant, as_square, distance_columns, distance_name, named, pairs, points_of, values_of, vr_persistence
from tesserae.functions.numeric import rounded

ALL = [PAIRWISE_DISTANCE, HYPERBOLICITY_DEFICIT, VR_PERSISTENCE_4_1]


def rows(spark, n, values):
    return spark.createDataFrame([tuple(map(float, v)) for v in values], ", ".join(f"{distance_name(*p)} double" for p in pairs(n)))


def evaluated(spark, f, n, values):
    cols = values_of(f, distance_columns(n))
    return [tuple(r) for r in rows(spark, n, values).select(*(c.alias(f"v{k}") for k, c in enumerate(cols))).collect()]


def test_hand_computed_quadruples(spark):
    star = [sum(x) for x in ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))]  # leaves at 1, 2, 3 and 4 from one middle
    cycle = (3, 6, 3, 3, 6, 3)  # four places on a circle of length 12
    odd = (4, 6, 5, 5, 7, 4)
    assert evaluated(spark, HYPERBOLICITY_DEFICIT, 4, [star, cycle, odd]) == [(0.0,), (3.0,), (1.5,)]
    # The second largest distance of each point, at most; the largest of each, at least.
    assert evaluated(spark, VR_PERSISTENCE_4_1, 4, [star, cycle, odd, (2, 9, 7, 7, 9, 2), (5,) * 6]) == [(0, 0), (3, 6), (5, 6), (7, 9), (0, 0)]
    assert evaluated(spark, vr_persistence(2), 2, [(3,)]) == [(0.0, 3.0)]


@pytest.mark.parametrize("n", [4, 6])
def test_invariants_like_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(1, 9, (200, n * (n - 1) // 2))
    square = np.zeros((200, n, n))
    for k, (a, b) in enumerate(pairs(n)):
        square[:, a, b] = square[:, b, a] = values[:, k]
    two = np.sort(square, axis=2)[:, :, -2:]
    birth, death = two[:, :, 0].max(1), two[:, :, 1].min(1)
    want = [(b, d) if b < d else (0.0, 0.0) for b, d in zip(birth, death)]
    assert evaluated(spark, vr_persistence(n), n, values) == want
    if n == 4:
        sums = np.sort(np.stack([values[:, 0] + values[:, 5], values[:, 2] + values[:, 3], values[:, 1] + values[:, 4]]), axis=0)
        assert evaluated(spark, HYPERBOLICITY_DEFICIT, 4, values) == [(x,) for x in (sums[2] - sums[1]) / 2]
        got = rows(spark, 4, values).select(as_square(distance_columns(4)).alias("m")).collect()
        assert np.array_equal(np.array([r.m for r in got]), square)


def test_first_points_are_read(spark):
    values = np.random.default_rng(15).integers(1, 99, (30, 15)).astype(float)
    first = [k for k, (_, b) in enumerate(pairs(6)) if b < 4]
    assert evaluated(spark, HYPERBOLICITY_DEFICIT, 6, values) == evaluated(spark, HYPERBOLICITY_DEFICIT, 4, values[:, first])


def test_invariant_checks():
    for wrong in ({"n": 1}, {"n": 2.5}, {"lip": 0}, {"lam": -1}):
        with pytest.raises(ValueError):
            Invariant(lambda d: (d[0, 1],), **{"n": 2, **wrong})
    assert Invariant(len, 3, 2.0).lam == 2.0 and Invariant(len, 3).name == "len"
    with pytest.raises(ValueError):
        vr_persistence(5)
    with pytest.raises(ValueError):
        points_of(4)
    assert [points_of(k) for k in (1, 3, 6, 10)] == [2, 3, 4, 5]
    with pytest.raises(TypeError):
        named(lambda d: d[0, 1], 4)
    with pytest.raises(ValueError):
        named([PAIRWISE_DISTANCE, PAIRWISE_DISTANCE], 4)
    with pytest.raises(ValueError):
        named([HYPERBOLICITY_DEFICIT], 3)


def test_rounding_like_numpy(spark):
    x = np.arange(-2000, 2000) / 1000
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select(rounded(F.col("x"), 2).alias("r"))
    assert [r.r for r in df.collect()] == np.round(x, 2).tolist()


def test_metrics(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 40, 5))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a array<double>, b array<double>")
    py = metrics.from_python(lambda x, y: np.abs(x - y).sum(1))
    got = df.select(metrics.euclidean(F.col("a"), F.col("b")), metrics.manhattan(F.col("a"), F.col("b")), py(F.col("a"), F.col("b"))).collect()
    assert np.allclose(got, np.stack([np.sqrt(((a - b) ** 2).sum(1)), np.abs(a - b).sum(1), np.abs(a - b).sum(1)], 1))
    s = ["".join(rng.choice(list("ACGT"), 70)) for _ in range(20)]
    df = spark.createDataFrame(list(itertools.product(s, s)), "a string, b string")
    packed = metrics.hamming_packed(metrics.pack_symbols(F.col("a")), metrics.pack_symbols(F.col("b")))
    plain = metrics.hamming(F.split("a", ""), F.split("b", ""))
    got = df.select(packed.alias("p"), plain.alias("q"), "a", "b").collect()
    assert all(r.p == r.q == sum(x != y for x, y in zip(r.a, r.b)) for r in got)
    with pytest.raises(ValueError, match="hamming"):
        metrics.resolve("chebyshev")


def test_published_sample_sizes():
    assert bounds.sample_size(0.1, 0.995, 4, 2) == 117_207_232
    assert bounds.sample_size(0.1, 1 - 0.05 / 15, 4, 1) == 53_433_249
    assert bounds.sample_size(0.05, 0.999, 4, 1) == 3_385_553_635
    assert bounds.sample_size(0.2, 0.999, 4, 1) == 874_241
    assert bounds.sample_size_real_valued(0.1, 0.95, 1) == 1_324
    assert bounds.sample_size_real_valued(0.001, 0.999, 1) == 18_255_749
    assert bounds.sample_size(0.1, 0.95, 4, 1, lip=2, lam=1) > 10**9


@pytest.mark.parametrize(("n", "p", "eps", "lip", "lam"), [(2, 1, 0.1, 1, 1), (3, 1, 0.2, 1, 1), (4, 2, 0.2, 2, 1), (4, 4, 0.3, 1, 1), (3, 2, 0.2, 2, 2)])
def test_size_and_accuracy_are_inverse(n, p, eps, lip, lam):
    size = bounds.sample_size(eps, 0.99, n, p, lip, lam)
    assert bounds.wasserstein_bound(size, 0.99, n, p, lip=lip, lam=lam) <= eps * (1 + 1e-12) < bounds.wasserstein_bound(size - 1, 0.99, n, p, lip=lip, lam=lam) * (1 + 1e-9)


def test_bounds_scale_and_agree():
    assert bounds.wasserstein_bound(1000, 0.9, 4, 2, D=3) == pytest.approx(3 * bounds.wasserstein_bound(1000, 0.9, 4, 2))
    assert bounds.wasserstein_moment_bound(10**6, 2, 2) == pytest.approx(bounds.kappa_1(1, 2) / 1000)
    assert bounds.kappa_1(1, 2) == pytest.approx(bounds._line_constant(2))
    size = bounds.sample_size_real_valued(0.05, 0.99, 2, 0.5)
    assert bounds.wasserstein_bound_real_valued(size, 0.99, 2, lam=0.5) <= 0.05 < bounds.wasserstein_bound_real_valued(size - 1, 0.99, 2, lam=0.5)
    assert 10 ** bounds.log10_sample_size(0.1, 0.99, 4, 1) == pytest.approx(bounds.sample_size(0.1, 0.99, 4, 1), rel=1e-6)
    assert bounds.log10_sample_size(5, 0.5, 4, 1) == 0
    with pytest.warns(UserWarning):
        assert bounds.sample_size(0.3, 0.9, 3, 3, method="Markov") > 0
    with pytest.warns(UserWarning):
        assert bounds.wasserstein_bound_md(bounds.sample_size(0.5, 0.9, 4, 4, method="MD"), 0.9, 4, 4) <= 0.5 + 1e-9
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        bounds.sample_size(0.3, 0.9, 4, 2, method="MD")
    with pytest.raises(ValueError):
        bounds.sample_size(0.3, 0.9, 4, 2, method="Chebyshev")
    with pytest.raises(ValueError):
        bounds.fournier_constant(4, 3)
    assert bounds.fournier_constant(4, 3, N=10**6) > bounds.fournier_constant(4, 3, N=10)
    with pytest.raises(ValueError):
        bounds.sample_size_real_valued(0.1, 0.9, 0.5)
    with pytest.warns(UserWarning):
        assert all(k > 0 for k in (bounds.kappa_1(2, 3, 2.0), bounds.kappa_2(1000, 2, 1, 2.0), bounds.kappa_3(6, 1, 2.0)))
    with pytest.warns(UserWarning):
        assert bounds.N_cover(0.5, 2, 2.0) == 4 and bounds.K_cover(3, 2.0) == 8


def test_guarantees(spark):
    got = bounds.guaranteed_accuracy(53_433_249, ALL, 1, 1 - 0.05 / 15)
    assert [(k, round(g.accuracy, 6), g.statement) for k, g in got.items()] == [("pairwise_distance", 0.000561, "Prop 6.6"), ("hyperbolicity_deficit", 0.000561, "Prop 6.6"), ("vr_persistence_4_1", 0.1, "Cor 6.3")]
    assert bounds.guaranteed_accuracy(1000, {"f": Invariant(len, 4, 2.0, 1.0)}, 1)["f"].statement == "Cor 6.5"
    assert bounds.guarantees(spark, 1000, ALL, 2).count() == 3
    for wrong, kind in (((0, ALL), ValueError), ((10, [len]), TypeError), ((10, [ALL[0], ALL[0]]), ValueError)):
        with pytest.raises(kind):
            bounds.guaranteed_accuracy(*wrong, 1)


def test_command_line(capsys):
    cli.main(["bound", "-n", "4", "-p", "1", "-e", "0.1", "-a", str(1 - 0.05 / 15)])
    out = capsys.readouterr().out
    assert "53,433,249" in out and "Corollary 6.3" in out
    cli.main(["bound", "-L", "2", "--lambda", "1", "-e", "0.5"])
    assert "Corollary 6.5" in capsys.readouterr().out
    cli.main(["bound-real-valued", "-p", "1", "-e", "0.1", "-a", "0.95"])
    out = capsys.readouterr().out
    assert "Proposition 6.6" in out and "1,324" in out
    cli.main(["accuracy", "-N", "1e6", "hyperbolicity_deficit"])
    out = capsys.readouterr().out
    assert "1,000,000" in out and "Prop 6.6" in out and "statement" in out and "pairwise_distance" not in out
    cli.main(["accuracy", "-N", "53433249", "-p", "1", "--as", "json"])
    records = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["invariant"] for r in records] == list(NAMED) and {r["n_samples"] for r in records} == {53433249}
    cli.main(["bound-real-valued", "-p", "1", "-e", "0.1", "-a", "0.95", "--as", "tsv"])
    head, row = (x.split("\t") for x in capsys.readouterr().out.splitlines())
    assert dict(zip(head, row))["tuples"] == "1324"
    with pytest.raises(SystemExit):
        cli.main(["accuracy", "-N", "100", "curvature"])


def test_substitution_laws(spark):
    phi = (0.0, 0.0, -10.0, -10.0)
    assert laws.hb_factor(0) == 1 and laws.hb_factor(1) == pytest.approx(1 / (1 - math.exp(-1)))
    assert laws.hb_law(0.3, 4, 1.0, (1.0,) * 4) == pytest.approx(laws.jc_law(0.3, 4))
    assert laws.hb_law(500.0, 4, 1.0, phi) == pytest.approx(laws.hb_stationary(phi), abs=1e-9)
    assert np.allclose(laws.hb_generator(4, 1.0, phi).sum(1), 0)
    for wrong in ((1, 1.0, [0.0]), (2, 0.0, [0.0, 0.0]), (3, 1.0, [0.0, 0.0])):
        with pytest.raises(ValueError):
            laws.hb_generator(*wrong)
    layers = laws.model_layers(spark)
    assert layers.count() == 10
    p = {(r.family, r.time): r.p for r in laws.mismatch(layers).collect()}
    assert p["JC", 0.5] == pytest.approx(0.75 * (1 - math.exp(-4 / 3))) and p["JC", math.inf] == pytest.approx(0.75)
    pmf = laws.binomial_pmf(spark.createDataFrame([(0.0,), (1.0,), (0.3,)], "p double"), 10).collect()
    for q in (0.0, 1.0, 0.3):
        own = {r.value: r.prob for r in pmf if r.p == q}
        assert [own[k] for k in range(11)] == pytest.approx([math.comb(10, k) * q**k * (1 - q) ** (10 - k) for k in range(11)])
    one = laws.pair_sum_law(spark.createDataFrame([(4, [0.25] * 4)], "k int, rho array<double>"))
    closed = laws.uniform_pair_sum_law(spark, 4)
    assert {tuple(r)[1:4]: pytest.approx(r.prob) for r in one.collect()} == {tuple(r)[1:4]: r.prob for r in closed.collect()}
    law = {r.deficit: r.prob for r in laws.hyperbolicity_law(laws.uniform_pair_sum_law(spark, 2), 12, ["k"]).collect()}
    assert sum(law.values()) == pytest.approx(1) and all(v == pytest.approx(0, abs=1e-12) for d, v in law.items() if d % 1)
    long = laws.hyperbolicity_law(laws.uniform_pair_sum_law(spark, 4), 400, ["k"])
    gap = laws.clt_mass(long, 4, 400).agg(F.max(F.abs(F.col("mass") - F.col("prob")))).first()[0]
    assert gap < 0.002


def test_model_sampler_counts_all_and_comes_near_the_law(spark):
    rows = laws.pattern_law(spark.createDataFrame([(1, laws.jc_law(0.5, 4))], "k int, rho array<double>")).collect()
    patterns, probs = [tuple(r)[1:7] for r in rows], [r.prob for r in rows]
    a = {(r.birth, r.lifetime): r.cnt for r in laws.model_persistence(spark, patterns, probs, 30, 5000, 3).collect()}
    assert sum(a.values()) == 5000 and all(0 <= life <= birth or not birth for birth, life in a)
    assert a == {(r.birth, r.lifetime): r.cnt for r in laws.model_persistence(spark, patterns, probs, 30, 5000, 3, partitions=7).collect()}
    b = {(r.birth, r.lifetime): r.cnt for r in laws.model_persistence(spark, patterns, probs, 30, 5000, 3, mode="md5").collect()}
    assert sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}) / 5000 < 0.15


def test_packed_tiles_are_exact():
    """Two rows a product: equal, opposite and random words, odd and even numbers of rows, several widths."""
    rng = np.random.default_rng(12)
    for n, m, width in ((1, 1, 1), (5, 3, 21), (4, 7, 22), (7, 2, 64), (2, 2, 850)):
        a, b = (rng.integers(-(2**63), 2**63 - 1, (k, width)) for k in (n, m))
        b[0], b[-1] = a[0], ~a[-1]
        want = [[kernels.packed_rows(x[None].copy(), y[None])[0] for y in b] for x in a]
        assert (kernels.packed_tile(a, b) == np.array(want)).all()
    assert kernels._WORDS * 96 < float(kernels._TWO) / 2


def test_ready_rows_and_columns_are_exact():
    """Three rows a product: all symbols alike, all different, and random ones, any number of rows, pieces of up to 255 symbols."""
    rng = np.random.default_rng(13)
    for n, m, width in ((1, 1, 1), (2, 3, 8), (4, 5, 7), (5, 300, 64), (6, 2, 85)):
        a, b = (rng.integers(-(2**63), 2**63 - 1, (k, width)) for k in (n, m))
        b[0], b[-1], a[-1] = a[0], ~a[0], -1 if n > 1 else a[-1]
        if n > 3:
            a[:2], b[1] = -1, -1
            a[2] = 0
        got = kernels.packed_columns(b)(kernels.packed_ready(a))
        assert got.dtype == np.uint16 and (got == [[kernels.packed_rows(x[None].copy(), y[None])[0] for y in b] for x in a]).all()
    assert kernels._COUNTED * (1 + 256 + 256**2) < 1 << 24
