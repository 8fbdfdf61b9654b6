import datetime
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.functions.invariants import HYPERBOLICITY_DEFICIT, PAIRWISE_DISTANCE, VR_PERSISTENCE_4_1
from tesserae.functions.metrics import from_python, hamming_packed, manhattan, pack_symbols
from tesserae.operators import alignment, blocks, distributions, draws, histograms, mds, ordering, progress, slices, tiles
from tesserae.operators.space import precomputed, space
from tesserae.plans import catalogue
from tesserae.sources import fasta, tables
from tesserae.streaming import histograms as streamed

ALL = [PAIRWISE_DISTANCE, HYPERBOLICITY_DEFICIT, VR_PERSISTENCE_4_1]
RNG = np.random.default_rng(0)
POINTS = RNG.normal(size=(60, 3))
SYMBOLS = RNG.integers(0, 4, (60, 30))


@pytest.fixture(scope="module")
def symbols(spark):
    return space(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(SYMBOLS)], "pid long, x array<int>"), "x", "hamming")


@pytest.fixture(scope="module")
def points(spark):
    return space(spark.createDataFrame([(k, v.tolist(), float(k in (0, 1))) for k, v in enumerate(POINTS)], "pid long, x array<double>, w double"), "x", "euclidean", weight="w")


def counts(df):
    return {tuple(r)[:-1]: r.cnt for r in df.collect()}


@pytest.mark.parametrize("mode", draws.MODES)
def test_prefix_and_partitions(spark, symbols, mode):
    get = lambda start, stop, parts: {r.t: tuple(r)[1:] for r in draws.tuples(symbols, 4, start, stop, 7, mode, parts).collect()}
    whole = get(0, 3000, 3)
    assert len(whole) == 3000 and whole == get(0, 3000, 7)
    assert get(1000, 1300, 2) == {t: v for t, v in whole.items() if 1000 <= t < 1300}
    share = np.bincount(np.array(list(whole.values())).ravel(), minlength=60) / 12000
    assert abs(share - 1 / 60).max() < 0.006


def test_draws_as_sql_functions(spark, symbols):
    """They are the draws of ``tuples``; ranges and unread slots are pruned."""
    draws.register_draws(spark)
    for mode in ("xx", "md5"):
        text = "SELECT id AS t, " + ", ".join(f"draw_{mode}(7, id, {k}, 60) AS i{k}" for k in range(3)) + " FROM range(50, 400)"
        assert sorted(map(tuple, spark.sql(text).collect())) == sorted(map(tuple, draws.tuples(symbols, 3, 50, 400, 7, mode).collect()))
        plan = spark.sql(f"SELECT t, i1 FROM ({text})")._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (50, 400" in plan and "AS i1" in plan and "AS i0" not in plan and "AS i2" not in plan
    big = 3 << 56  # tries beyond the last multiple
    got = spark.sql(f"SELECT draw_xx(1, id, 0, {big}) AS u FROM range(2000)")
    want = spark.range(2000).withColumnRenamed("id", "t").select(draws.uniform_words(1, 1, "xx", big)[0].alias("u"))
    assert sorted(r.u for r in got.collect()) == sorted(r.u for r in want.collect())


def test_numpy_draws_follow_the_generator(spark, symbols):
    rng = np.random.default_rng(np.random.SeedSequence(5, spawn_key=(1,)))
    want = rng.integers(0, 60, (1024, 3))
    got = draws.tuples(symbols, 3, 1024, 2048, 5, "numpy").orderBy("t").collect()
    assert np.array_equal(np.array([tuple(r)[1:] for r in got]), want)


@pytest.mark.parametrize("mode", draws.MODES)
def test_weighted_draws(spark, points, mode):
    got = draws.tuples(points, 2, 0, 2000, 3, mode).collect()
    assert len(got) == 2000 and {i for r in got for i in (r.i0, r.i1)} == {0, 1}
    d = distributions.distribution(points, PAIRWISE_DISTANCE, 2, 2000, mode=mode, decimals=9)
    assert {v for (v,) in counts(d)} == {0.0, round(float(np.linalg.norm(POINTS[0] - POINTS[1])), 9)}


def test_integer_weights(spark):
    df = spark.createDataFrame([(k, k, w) for k, w in enumerate([3, 0, 5, 0, 0, 1000, 2])], "pid long, x int, w long")
    s = space(df, "x", "hamming", weight="w")
    got = draws.tuples(s, 3, 0, 4000, 1, "md5").select(F.explode(F.array("i0", "i1", "i2")).alias("i")).groupBy("i").count().collect()
    share = {r.i: r["count"] / 12000 for r in got}
    assert set(share) == {0, 2, 5, 6} and share[5] == pytest.approx(1000 / 1010, abs=0.01)


def test_histograms_are_those_of_the_measure(spark, symbols):
    rows = distributions.curvature_measure(symbols, 4, 2000, 7)
    got = counts(distributions.distributions(symbols, ALL, 4, 2000, 7))
    want = {}
    for f in ALL:
        one = distributions.histogram(distributions.tagged_values(rows, [(f.name, f)], 4))
        for r in one.collect():
            r = r.asDict()
            want[f.name, r["v0"], r.get("v1")] = r["cnt"]
    assert got == want and sum(v for (name, *_), v in got.items() if name == "pairwise_distance") == 2000
    for f in ALL:
        assert counts(distributions.distribution(symbols, f, 4, 2000, seed=7)) == {k[1:] if f is VR_PERSISTENCE_4_1 else k[1:2]: v for k, v in got.items() if k[0] == f.name}


def test_metrics_agree_with_precomputed(spark, symbols):
    d = (SYMBOLS[:, None] != SYMBOLS[None]).sum(2)
    pre = precomputed(spark.createDataFrame([(i, j, float(d[i, j])) for i in range(60) for j in range(60)], "i long, j long, d double"))
    assert counts(distributions.distributions(pre, ALL, 4, 1500, 7)) == counts(distributions.distributions(symbols, ALL, 4, 1500, 7))
    city = np.abs(POINTS[:, None] - POINTS[None]).sum(2)
    pre = precomputed(spark.createDataFrame([(i, j, float(city[i, j])) for i in range(60) for j in range(60)], "i long, j long, d double"))
    s = space(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(POINTS)], "pid long, x array<double>"), "x", from_python(lambda a, b: np.abs(a - b).sum(1)))
    assert counts(distributions.distribution(pre, PAIRWISE_DISTANCE, 2, 500, decimals=9)) == counts(distributions.distribution(s, PAIRWISE_DISTANCE, 2, 500, decimals=9))


def test_checks(spark, symbols):
    df = spark.createDataFrame([(0, 1), (2, 1)], "pid long, x int")
    with pytest.raises(ValueError):
        space(df, "x", "hamming")
    with pytest.raises(ValueError):
        space(df.where("pid = 0").withColumn("w", F.lit(0.0)), "x", "hamming", weight="w")
    with pytest.raises(ValueError):
        space(df.where("pid > 5"), "x", "hamming")
    with pytest.raises(ValueError):
        precomputed(spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "i long, j long, d double"))
    for n, size in ((1, 5), (4, 0)):
        with pytest.raises(ValueError):
            distributions.sample_tuples(symbols, n, size)
    with pytest.raises(ValueError):
        draws.tuples(symbols, 2, 0, 5, mode="sobol")
    with pytest.raises(ValueError):
        distributions.collected(distributions.curvature_measure(symbols, 4, 100), 100, max_bytes=100)


def test_measure_written_and_read(spark, symbols, tmp_path):
    """Blocks are written once, a broken or shorter run goes on, and a slice opens only its blocks."""
    out = str(tmp_path / "m")
    b = distributions.collected(distributions.curvature_measure(symbols, 3, 300), 300)
    a = distributions.curvature_measure(symbols, 3, 250, out=out, block=100)
    assert distributions.collected(a, 250) == b[:250]
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "m" / "block=0").rglob("*.parquet")}
    (tmp_path / "m" / "block=1" / "stop=200" / "_SUCCESS").unlink()  # as a write that broke leaves it
    with pytest.raises(ValueError):
        distributions.measure_slice(spark, out, 0, 250, 100)
    a = distributions.curvature_measure(symbols, 3, 300, out=out, block=100)
    assert distributions.collected(a, 300) == b and stamps == {p: p.stat().st_mtime_ns for p in stamps}
    part = distributions.measure_slice(spark, out, 120, 190, 100)
    assert distributions.collected(part, 70) == b[120:190] and {f.split("/block=")[1][:10] for f in part.inputFiles()} == {"1/stop=200"}
    with pytest.raises(ValueError):
        distributions.measure_slice(spark, out, 0, 301, 100)


def test_cumulated_over_ranges(spark):
    """Sums over ranges are those of one window, by group, in both directions, null groups and empty tables included."""
    rng = np.random.default_rng(6)
    rows = [(g, float(v), int(c)) for g in ("a", "b", None) for v, c in zip(rng.choice(500, 40, replace=False), rng.integers(1, 9, 40))]
    df = spark.createDataFrame(rows, "g string, v double, c long")
    for down in (False, True):
        for by in ((), ("g",)):
            own = df if by else df.groupBy("v").agg(F.sum("c").alias("c"))
            got = ordering.cumulated(own, by, "v", F.col("c"), "s", down, "next").collect()
            groups = {}
            for r in own.collect():
                groups.setdefault(r.g if by else 0, []).append((r.v, r.c))
            want = set()
            for g, held in groups.items():
                held.sort(reverse=down)
                sums = np.cumsum([c for _, c in held]).tolist()
                want |= {(g, v, s, held[k + 1][0] if k + 1 < len(held) else None) for k, ((v, _), s) in enumerate(zip(held, sums))}
            assert {(r.g if by else 0, r.v, r.s, r.next) for r in got} == want and len(got) == len(want)
    assert ordering.cumulated(df.limit(0), (), "v", F.col("c"), "s").count() == 0


def test_reductions_have_no_window_over_everything(spark):
    """Medians, thresholds, transport distances and shares of long histograms; plans cut them to ranges."""
    rng = np.random.default_rng(7)
    v, c = rng.normal(size=4000), rng.integers(1, 5, 4000)
    h = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, c)], "v0 double, cnt long")
    other = spark.createDataFrame([(float(a) + 0.5, int(b)) for a, b in zip(v, c)], "v0 double, cnt long")
    order = np.argsort(v)
    cum = np.cumsum(c[order])
    results = [histograms.weighted_median(h), histograms.wasserstein1(h, other), histograms.integer_pmf(h, 2), histograms.pmf(h)]
    assert results[0].first().median == v[order][np.searchsorted(cum * 2, cum[-1])]
    assert results[1].first().w1 == pytest.approx(0.5)
    assert sum(r.prob for r in results[2].collect()) == pytest.approx(1) and sum(r.prob for r in results[3].collect()) == pytest.approx(1)
    d = histograms.density_thresholds(h.withColumn("prob", F.abs("v0")), (0.5, 0.9))
    down = np.sort(np.abs(v))[::-1]
    assert [r.threshold for r in d.orderBy("mass").collect()] == [down[np.searchsorted(np.cumsum(down), m * down.sum())] for m in (0.5, 0.9)]
    for df in [*results, d]:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Window" in line and "_stride" not in line for line in plan.split("\n")), plan


def test_progress(spark, symbols, capsys):
    """Shares rise in steps, each printed once; the last is 100 and only of an action that ended well."""
    import io

    out = io.StringIO()
    steps = progress.Steps("x", out)
    for done, total in ((0, 0), (1, 40), (2, 40), (2, 40), (1, 40), (13, 40), (39, 40), (30, 80)):
        steps.at(done, total)
    steps.end()
    steps.end()
    assert out.getvalue().split("\n") == ["x: 5 %", "x: 30 %", "x: 95 %", "x: 100 %", ""]
    out = io.StringIO()
    with progress.progress(spark, "sum", out=out):
        slow = spark.range(0, 40, 1, 40).mapInArrow(lambda batches: (__import__("time").sleep(0.15) or b for b in batches), "id long")
        assert slow.agg(F.sum("id")).first()[0] == 780
    lines = out.getvalue().strip().split("\n")
    shares = [int(x.removeprefix("sum: ").removesuffix(" %")) for x in lines]
    assert len(shares) > 2 and shares == sorted(set(shares)) and shares[-1] == 100 and all(x % 5 == 0 for x in shares)
    out = io.StringIO()
    with pytest.raises(ZeroDivisionError), progress.progress(spark, "x", out=out):
        1 / 0
    assert "100" not in out.getvalue() and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    want = counts(distributions.distributions(symbols, ALL, 4, 500, 7))
    capsys.readouterr()
    assert counts(distributions.distributions(symbols, ALL, 4, 500, 7, report=True)) == want
    assert capsys.readouterr().err.strip().split("\n")[-1] == "tuples: 100 %"
    distributions.distributions(symbols, ALL, 4, 500, 7).count()
    assert "%" not in capsys.readouterr().err


def test_fasta_ranges(spark, tmp_path):
    """Any cut of the bytes gives each record once, with the same number; nothing is shuffled."""
    import gzip

    rng = np.random.default_rng(12)
    folder = tmp_path / "f"
    folder.mkdir()
    want = []
    for k, name in enumerate(("a.fa", "b.fa", "c.fa")):
        text, ends = "" if k else "no header yet\nACGT\n", "\r\n" if k == 1 else "\n"
        for j in range(25):
            seq = "".join(rng.choice(list("ACGT-"), rng.integers(0, 90)))
            body = ends.join(seq[x : x + 20] for x in range(0, len(seq), 20))
            want.append(((k << 40) + len(text), f"s{k}.{j}|x>y", seq))
            text += f">s{k}.{j}|x>y{ends}" + body + ends * bool(body)
        text = text.removesuffix("\n") if k == 2 else text
        (folder / name).write_bytes(text.encode())
    (folder / "_SUCCESS").write_text("")
    (folder / "empty.fa").write_text("")
    for size in (1, 7, 64, 1000, 1 << 20):
        df = fasta.read_fasta(spark, str(folder), size) if size > 1 else fasta.read_fasta(spark, str(folder), 13)
        assert sorted(map(tuple, df.collect())) == want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, fasta.read_fasta(spark, f"file://{folder}", 100).collect())) == want
    with gzip.open(tmp_path / "z.fa.gz", "wb") as f:
        f.write((folder / "a.fa").read_bytes())
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "z.fa.gz"), 50).collect())) == want[:25]
    (tmp_path / "none.fa").write_text("no records\n")
    assert fasta.read_fasta(spark, str(tmp_path / "none.fa")).count() == 0
    with pytest.raises(Exception, match="none such"):
        fasta.read_fasta(spark, str(tmp_path / "none such")).count()


def test_fasta_records_longer_than_reads(monkeypatch):
    """What was read is let go, and a range within a record finds no header of its own."""
    import pyarrow as pa

    monkeypatch.setattr(fasta, "READ_BYTES", 11)
    text = b"xx\n>a\n" + b"ACGTACGT\n" * 30 + b">b\nAC\n>c\n>d\n" + b"G" * 100
    whole = [(k, text[k + 1 :].split(b"\n>")[0]) for k in range(len(text)) if text[k : k + 1] == b">"]
    for size in (1, 2, 3, 5, 17, 100, 1000):
        got = []
        for start in range(0, len(text), size):
            f = pa.BufferReader(text)
            f.seek(max(start - 1, 0))
            got += fasta.record_bytes(f, start, min(start + size, len(text)))
        assert got == whole, size


def test_drops_are_counted_while_writing(spark, tmp_path):
    from pyspark.sql import Observation

    rows = [(0, "v|E1|2021-01-01", "ACG-"), (1, "v|E2|2021-01", "ACGT"), (2, "v|E3|2021-01-02", "ACNT"), (3, "v|E4|2021-01-03", "ACGT"), (4, "v", "NNNN")]
    records = spark.createDataFrame(rows, "rec_no long, header string, seq string")
    seen, gaps = Observation("complete"), Observation("gaps")
    alignment.complete(records, seen).write.parquet(str(tmp_path / "c"))
    assert seen.get == {"records": 5, "bad_characters": 2, "no_date": 1}
    kept = spark.read.parquet(str(tmp_path / "c"))
    alignment.ungapped(kept, 0.6, gaps).write.parquet(str(tmp_path / "u"))
    assert gaps.get == {"gap": 1, "aligned": 2} and kept.columns == ["rec_no", "header", "seq", "epi_isl", "date"]
    assert alignment.width_of(kept, 2) == 4
    with pytest.raises(ValueError, match="2 records, not 3"):
        alignment.width_of(kept, 3)


def test_plan_reads_only_needed_slots(symbols):
    plan = distributions.distribution(symbols, PAIRWISE_DISTANCE, 6, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2


def test_points_beyond_the_broadcast_bound(spark, symbols, monkeypatch):
    """The plan for large tables gives the distances of the one for small tables, heavy points included."""
    w = [1000] * 2 + [1] * 58
    heavy = space(spark.createDataFrame([(k, v.tolist(), c) for k, (v, c) in enumerate(zip(SYMBOLS, w))], "pid long, x array<int>, w long"), "x", "hamming", weight="w")
    want = [counts(distributions.distributions(s, ALL, 4, 1500, 7)) for s in (symbols, heavy)]
    monkeypatch.setattr("tesserae.operators.space.BROADCAST_BYTES", 1)
    monkeypatch.setattr("tesserae.operators.distributions.BROADCAST_BYTES", 1 << 12)
    assert [counts(distributions.distributions(s, ALL, 4, 1500, 7)) for s in (symbols, heavy)] == want


@pytest.mark.parametrize("total", [2**31 + 12345, 2**32, 3 * 2**32 + 7, 2**34, 2**45 + 1])
@pytest.mark.parametrize("mode", ["xx", "md5"])
def test_draws_are_uniform_at_any_total(spark, mode, total):
    """Chi-square over ten equal parts, and numbers beyond 2^32 are reached."""
    t, n = spark.range(40_000).withColumnRenamed("id", "t"), 2
    cells = t.select(F.explode(F.array(*draws.uniform_words(5, n, mode, total))).alias("u"))
    r = cells.agg(F.max("u"), F.min("u")).first()
    assert 0 <= r[1] and r[0] < total and r[0] > 0.999 * total
    got = np.zeros(10)
    for k, c in cells.groupBy(F.floor(F.col("u").cast("double") * 10 / float(total)).cast("int").alias("k")).count().collect():
        got[min(k, 9)] += c
    assert ((got - 8000) ** 2 / 8000).sum() < 33.7  # 1e-4


@pytest.mark.parametrize("mode", draws.MODES)
@pytest.mark.parametrize("weight", [1_500_000_000, 4_000_000_000, 1 << 40])
def test_large_weights_are_drawn_by_share(spark, mode, weight):
    df = spark.createDataFrame([(0, 0, weight), (1, 1, weight), (2, 2, 2 * weight)], "pid long, x int, w long")
    s = space(df, "x", "hamming", weight="w")
    got = {r.i0: r["count"] for r in draws.tuples(s, 2, 0, 20_000, 9, mode).groupBy("i0").count().collect()}
    assert all(abs(got[k] - 20_000 * p) < 5 * (20_000 * p * (1 - p)) ** 0.5 for k, p in enumerate((0.25, 0.25, 0.5))), got


def test_words_beyond_the_last_multiple_are_drawn_anew(spark):
    total = 3 << 56  # a plain remainder of 60 bits would give the first third 0.375
    u = spark.range(30_000).withColumnRenamed("id", "t").select(draws.uniform_words(1, 1, "xx", total)[0].alias("u"))
    low = u.where(F.col("u") < F.lit(1 << 56)).count()
    assert abs(low - 10_000) < 450


def test_numpy_invariants_and_callbacks(spark, symbols):
    """Plain functions of distance rows, and callbacks that count batches."""
    rows = distributions.curvature_measure(symbols, 4, 1000, 7)
    d = np.array([tuple(r)[1:] for r in rows.collect()])
    got = counts(distributions.distributions(symbols, {"perimeter": lambda x: x.sum(1), "ends": lambda x: np.stack([x.min(1), x.max(1)], 1)}, 4, 1000, 7))
    want = {("perimeter", v, None): c for v, c in zip(*np.unique(d.sum(1), return_counts=True))}
    pairs, c = np.unique(np.stack([d.min(1), d.max(1)], 1), axis=0, return_counts=True)
    assert got == want | {("ends", *p): k for p, k in zip(pairs.tolist(), c)}
    with pytest.raises(TypeError):
        distributions.distributions(symbols, {"f": lambda x: x.sum()}, 4, 10)
    for square in (False, True):
        def f(x, square=square):
            v = x.max((1, 2)) if square else x.max(1)
            return dict(zip(*(a.tolist() for a in np.unique(v, return_counts=True))))

        out = distributions.batch_histogram(rows, f, 4, square=square)
        assert counts(out) == {(v,): c for v, c in zip(*np.unique(d.max(1), return_counts=True))}
        assert [r.v0 for r in distributions.ordered(out).collect()] == sorted(set(d.max(1)))
    with pytest.raises(Exception, match="count each row once"):
        distributions.batch_histogram(rows, lambda x: {0.0: 1}, 4).collect()


def test_running_total_over_strides(spark):
    rng = np.random.default_rng(2)
    keys = rng.choice(1000, 300, replace=False)
    df = spark.createDataFrame([(int(k), int(v)) for k, v in zip(keys, rng.integers(0, 9, 300))], "k long, v int")
    got = ordering.running_total(df, "k", F.col("v"), "before", stride=64).orderBy("k").collect()
    assert [r.before for r in got] == np.r_[0, np.cumsum([r.v for r in got])[:-1]].tolist()
    assert [r.pid for r in ordering.dense_index(df, "k").orderBy("k").collect()] == list(range(300))


def test_slices(spark):
    day = lambda m, d: datetime.date(2021, m, d)
    data = [(0, "b", day(1, 5)), (1, "a", day(3, 1)), (2, "b", day(2, 1)), (3, "c", None), (4, "a", day(1, 1)), (5, "d", day(9, 9))]
    records = spark.createDataFrame(data, "rec_no long, seq string, date date")
    forms = slices.deduplicated(records, ["seq"], date="date")
    assert [(r.seq, r.multiplicity) for r in forms.orderBy("uid").collect()] == [("b", 2), ("a", 2), ("c", 1), ("d", 1)]
    assert [r.seq for r in slices.deduplicated(records, ["seq"], min_count=2).orderBy("uid").collect()] == ["b", "a"]
    own = slices.tagged(records, forms, ["seq"])
    cutoffs = spark.createDataFrame([(day(1, 31),), (day(3, 1),), (day(2, 1),)], "cutoff date")
    got = {(r.cutoff, r.uid): r.weight for r in slices.cumulative_slices(own, cutoffs).collect()}
    by_key = slices.tagged(slices.cumulative_slices(records, cutoffs, ["seq"]), forms, ["seq"])
    assert got == {(r.cutoff, r.uid): r.weight for r in by_key.collect()}
    many = spark.range(20_000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("cutoff"))
    assert slices.cumulative_slices(own, many).where("cutoff = '2021-02-01' AND uid = 0").first().weight == 2
    assert got == {(day(1, 31), 0): 1, (day(1, 31), 1): 1, (day(2, 1), 0): 2, (day(2, 1), 1): 1, (day(3, 1), 0): 2, (day(3, 1), 1): 2}
    assert {(r.cutoff, r.n_records, r.n_forms) for r in slices.slice_sizes(slices.cumulative_slices(own, cutoffs)).collect()} == {(day(1, 31), 2, 2), (day(2, 1), 3, 2), (day(3, 1), 4, 2)}
    assert sum(r.share for r in slices.slice_measure(slices.cumulative_slices(own, cutoffs)).where(F.col("cutoff") == day(3, 1)).collect()) == 1
    assert {r.seq: r.slice for r in slices.first_slice(forms.where("seq <> 'c'"), cutoffs).collect()} == {"b": day(1, 31), "a": day(1, 31), "d": day(3, 1)}
    with pytest.raises(Exception, match="no dated record"):
        slices.first_seen(own).collect()
    assert {r.uid for r in slices.reference_form(own.withColumn("epi_isl", F.col("seq")), "a").collect()} == {1}
    assert slices.reference_form(own.withColumn("epi_isl", F.col("seq")), "zz").first().uid is None


def test_fasta_to_points(spark, tmp_path):
    lines = ["junk", ">v/1|E1|2021-01-01|x", "ACG", "T-A", ">v/2|E2|2021-03|x", "ACGTAA", ">v/3|E3|2021-02-03", "ACNTAA", ">v/4", "ACGTAA", ">v/5|E5|2020-12-31|y", "AAGT-A", ">v/6|E6|2021-05-05|y", "ACGTCA"]
    (tmp_path / "a.fasta").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    records = fasta.read_fasta(spark, str(tmp_path / "a.fasta"))
    got = records.orderBy("rec_no").collect()
    assert [r.header for r in got] == ["v/1|E1|2021-01-01|x", "v/2|E2|2021-03|x", "v/3|E3|2021-02-03", "v/4", "v/5|E5|2020-12-31|y", "v/6|E6|2021-05-05|y"]
    assert [r.seq for r in got] == ["ACGT-A", "ACGTAA", "ACNTAA", "ACGTAA", "AAGT-A", "ACGTCA"]
    assert [r.v for r in records.orderBy("rec_no").select(alignment.verdict(F.col("header"), F.col("seq")).alias("v")).collect()] == ["complete", "no date", "bad characters", "no date", "complete", "complete"]
    own = alignment.complete(records)
    assert own.count() == 3
    columns = alignment.gap_columns(own)
    assert {r.pos: r.dashes for r in columns.collect() if r.dashes} == {4: 2}
    assert [r.min_frac for r in alignment.gap_rows(own, columns).orderBy("rec_no").collect()] == [2 / 3, 2 / 3, float("inf")]
    profile = alignment.gap_profile(columns, alignment.gap_rows(own, columns), [0.0, 0.7])
    assert [tuple(r) for r in profile.orderBy("threshold").collect()] == [(0.0, 5, 3), (0.7, 6, 1)]
    assert [r.seq for r in alignment.ungapped(own, 0.1).orderBy("rec_no").collect()] == ["ACGTA", "AAGTA", "ACGTA"]
    assert [r.seq for r in alignment.compacted(own).orderBy("rec_no").collect()] == ["C-", "A-", "CC"]
    assert alignment.width_of(own) == 6
    with pytest.raises(ValueError):
        alignment.width_of(own.unionByName(own.withColumn("seq", F.lit("AC"))))
    with pytest.raises(ValueError):
        alignment.width_of(own.where("false"))
    fasta.write_fasta(own, str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).select("header", "seq").exceptAll(own.select("header", "seq")).count() == 0
    tables.write_dates(records.withColumns({"epi_isl": alignment.accession(F.col("header")), "date": alignment.complete_date(F.col("header"))}), str(tmp_path / "dates"))
    back = tables.read_dates(spark, str(tmp_path / "dates"))
    assert sorted(((r.epi_isl, r.date) for r in back.collect()), key=str) == sorted([("E1", datetime.date(2021, 1, 1)), ("E2", None), ("E3", datetime.date(2021, 2, 3)), ("", None), ("E5", datetime.date(2020, 12, 31)), ("E6", datetime.date(2021, 5, 5))], key=str)


def test_histogram_statistics(spark):
    h = spark.createDataFrame([(0.0, 6), (1.0, 3), (2.5, 1)], "v0 double, cnt long")
    r = histograms.deficit_stats(h).first()
    assert (r.hyp_p_zero, r.hyp_mean, r.hyp_max, r.hyp_half_share) == pytest.approx((0.6, 0.55, 2.5, 0.1))
    r = histograms.distance_stats(h, tail=1).first()
    assert (r.dist_mean, r.dist_max, r.dist_tail_ppm) == pytest.approx((0.55, 2.5, 1e5))
    assert histograms.weighted_median(h).first().median == 0.0
    d = spark.createDataFrame([(0.0, 0.0, 90), (2.0, 3.0, 4), (1.0, 4.0, 4), (5.0, 6.0, 2)], "v0 double, v1 double, cnt long")
    r = histograms.persistence_stats(d).first()
    assert (r.pers_nonzero_ppm, r.pers_life_one_share, r.pers_life_max, r.pers_birth_mode, r.pers_birth_mean, r.pers_birth_median) == pytest.approx((1e5, 0.6, 3.0, 1.0, 2.2, 2.0))
    assert histograms.wasserstein1(h, h).first().w1 == 0
    assert histograms.wasserstein1(h, spark.createDataFrame([(1.0, 5)], "v0 double, cnt long")).first().w1 == pytest.approx(0.75)
    assert counts(histograms.merge(h, h)) == {(0.0,): 12, (1.0,): 6, (2.5,): 2}
    assert {r.value: r.prob for r in histograms.integer_pmf(h, 2).collect()} == {0: 0.6, 2: 0.3, 5: 0.1}
    assert [r.threshold for r in histograms.density_thresholds(h, (0.5, 0.8, 0.95), "cnt").orderBy("mass").collect()] == [6, 3, 1]
    with pytest.raises(ValueError):
        histograms.density_thresholds(h, (1.0,), "cnt")
    kde = histograms.kde_curve(h, 0.3, 4).orderBy("x").collect()
    assert np.trapezoid([r.density for r in kde], [r.x for r in kde]) == pytest.approx(1)
    cells = spark.createDataFrame([(5, 2, 8), (3, 1, 2)], "birth long, lifetime long, cnt long")
    grid = histograms.density_grid(cells, 12, 5, 10)
    assert {(r.birth, r.lifetime): r.density for r in grid.where("density > 0").collect()} == {(5, 2): 0.8, (3, 1): 0.2}
    assert grid.where("lifetime > birth OR lifetime > 12 - birth").count() == 0
    smooth = histograms.density_grid(cells, 12, 5, 10, sigma=0.5)
    assert 0.7 < smooth.agg(F.sum("density")).first()[0] <= 1
    assert histograms.axis_limits(h).first().xmax == 2.5


def test_subsample_and_embedding(spark):
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(40, 2))
    s = space(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(flat)], "pid long, x array<double>"), "x", "euclidean")
    chosen = draws.subsample(s.points, 25, 4, pin=39)
    ids = sorted(r.pid for r in chosen.collect())
    assert len(ids) == 25 and 39 in ids and draws.subsample(s.points, 99, 4).count() == 40
    t = tiles.distance_tiles(chosen, s)
    d = tiles.matrix(t.rows.first().asDict())
    assert t.blocks == 1 and np.allclose(d, np.linalg.norm(flat[ids][:, None] - flat[ids][None], axis=2))
    _, history = mds.majorize(d, 1, max_iter=200)
    assert all(b <= a + 1e-9 * history[0] for a, b in zip(history, history[1:])), history[-5:]
    out = mds.embed(t, n_init=4, max_iter=400).orderBy("pid").collect()
    x = np.array([(r.x0, r.x1) for r in out])
    assert [r.pid for r in out] == ids and np.abs(mds._distances(x) - d).max() < 0.1 * d.max()


def test_embedding_over_many_tiles(spark, monkeypatch):
    """Passes over tiles take the steps of one whole matrix, and the stress never rises."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 3))
    s = space(spark.createDataFrame([(7 * k, v.tolist()) for k, v in enumerate(x)], "pid long, x array<double>"), "x", "euclidean", check=False)
    whole = tiles.distance_tiles(s.points, s)
    monkeypatch.setattr(tiles, "TILE", 16)
    cut = tiles.distance_tiles(s.points, s)
    assert (cut.size, cut.blocks, cut.rows.count()) == (16, 5, 15)
    d = tiles.matrix(whole.rows.first().asDict())
    last, told = mds.histories(cut, 2, 12, 5, 2, 1e-9)
    for k in range(2):
        want, history = mds.majorize(d, 5 + k, max_iter=12, eps=1e-9)
        assert np.allclose(told[k], history, rtol=1e-9) and all(b <= a * (1 + 1e-12) for a, b in zip(told[k], told[k][1:]))
        assert np.allclose(last[k] - last[k].mean(0), want, atol=1e-8)
    a, b = ({r.pid: (r.x0, r.x1, r.stress) for r in mds.embed(t, n_init=2, max_iter=12, seed=5).collect()} for t in (whole, cut))
    assert a.keys() == b.keys() == {7 * k for k in range(70)} and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    assert mds.embed(tiles.distance_tiles(s.points.limit(0), s)).count() == 0


def test_a_pass_over_tiles_is_one_job(spark, monkeypatch):
    """No pass reads stored tiles anew or shuffles parts that are small; a shuffle of larger ones changes nothing."""
    s = space(spark.range(40).selectExpr("id AS pid", "array(sin(id), cos(3 * id), id % 7) AS x"), "x", "euclidean", check=False)
    monkeypatch.setattr(tiles, "TILE", 16)
    t = tiles.distance_tiles(s.points, s)
    jobs = {}
    for steps in (2, 6):
        spark.sparkContext.setJobGroup(f"passes-{steps}", "passes")
        last, told = mds.histories(t, 2, steps, 1, 2, 0.0)
        jobs[steps] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes-{steps}"))
        assert [len(h) for h in told] == [steps, steps]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[6] - jobs[2] == 4
    monkeypatch.setattr(mds, "COLLECTED", 0)
    other, again = mds.histories(t, 2, 6, 1, 2, 0.0)
    assert np.allclose(last, other, atol=1e-9) and np.allclose(told, again, rtol=1e-9)


def test_passes_over_vectors_keep_points_and_no_pairs(spark, monkeypatch):
    """What executors keep grows with the points, not with their pairs; copies and near copies far from the origin have exact distances."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4)) + 1000
    x[100:140], x[140:180] = x[0], x[1:41] + 1e-6
    s = space(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "pid long, x array<double>"), "x", "euclidean", check=False)
    monkeypatch.setattr(tiles, "TILE", 16)
    t = tiles.distance_tiles(s.points, s)
    held = mds._held(t)
    assert held.map(lambda r: r[-1].nbytes).sum() <= (t.groups + 1) * x.nbytes < 300 * 300 * 8 / 2
    assert not held.getStorageLevel().useMemory
    held.unpersist()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(kernels.euclidean_again(x)(x), d, rtol=1e-9, atol=0)
    last, told = mds.histories(t, 2, 8, 5, 2, 1e-9)
    for k in range(2):
        want, history = mds.majorize(d, 5 + k, max_iter=8, eps=1e-9)
        assert np.allclose(told[k], history, rtol=1e-9) and np.allclose(last[k] - last[k].mean(0), want, atol=1e-8)


def test_passes_over_packed_points_keep_tiles_on_disk(spark, monkeypatch):
    """Where distances are not made again, tiles are kept, and not in memory; the steps are those of one whole matrix."""
    x = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, (40, 2))
    s = space(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "pid long, x array<long>"), "x", hamming_packed, check=False)
    monkeypatch.setattr(tiles, "TILE", 16)
    t = tiles.distance_tiles(s.points, s)
    held = mds._held(t)
    assert held.map(lambda r: r[-1].nbytes).sum() == 2 * (3 * 16 * 16 + 2 * 16 * 8 + 8 * 8) and not held.getStorageLevel().useMemory
    held.unpersist()
    _, told = mds.histories(t, 1, 5, 3, 2, 0.0)
    _, want = mds.majorize(kernels.packed_tile(x, x), 3, max_iter=5, eps=0.0)
    assert np.allclose(told[0], want, rtol=1e-9)


def test_counted_tiles_are_not_written(spark, monkeypatch):
    """Histograms and pairs of whole and other numbers come from tiles that are gone after that, whatever the groups."""
    monkeypatch.setattr(tiles, "TILE", 16)
    for group in (tiles.GROUP_BYTES, 1 << 11):
        monkeypatch.setattr(tiles, "GROUP_BYTES", group)
        s = space(spark.range(100).selectExpr("id AS pid", "array(id % 3, id % 5, id % 7) AS x"), "x", "hamming", check=False)
        written = []
        with monkeypatch.context() as m:
            m.setattr(tiles, "stored", lambda df, kind: written.append(kind))
            t = tiles.distance_tiles(s.points, s, 100, numbered=True)
            got = {r.v0: r.cnt for r in tiles.tile_histogram(t).collect()}
            rows = tiles.pair_rows(t).collect()
        want = {(i, j): sum(i % m != j % m for m in (3, 5, 7)) for j in range(100) for i in range(j)}
        assert not written and got == dict(Counter(want.values())) and len(rows) == len(want)
        assert {(r.i, r.j): r.d for r in rows} == want


def test_packed_tiles_make_columns_ready_once(spark, monkeypatch):
    """Rows of a block are made ready once for all blocks that they meet, columns once for several; counts are those of all pairs."""
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "GOING", 2)
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**63), 2**63 - 1, (150, 3))
    x[7], x[149] = x[0], ~x[0]
    s = space(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "pid long, x array<long>"), "x", hamming_packed, check=False)
    want = {(i, j): int(kernels.packed_rows(x[i : i + 1].copy(), x[j : j + 1])[0]) for j in range(150) for i in range(j)}
    for bound in (tiles.READY_BYTES, 0):
        monkeypatch.setattr(tiles, "READY_BYTES", bound)
        t = tiles.distance_tiles(s.points, s, 150, numbered=True)
        assert {r.v0: r.cnt for r in tiles.tile_histogram(t).collect()} == dict(Counter(want.values()))
        assert {(r.i, r.j): r.d for r in tiles.pair_rows(t).collect()} == want
    blocks = [(0, 0, b, (np.arange(16), x[16 * b : 16 * b + 16])) for b in range(2)] + [(0, 1, b, (np.arange(16), x[16 * b : 16 * b + 16])) for b in range(2, 6)]
    made = Counter()
    told = kernels.Kernel(None, None, ("long",), 32, None, lambda a: made.update(["ready"]) or kernels.packed_ready(a), lambda b: made.update(["columns"]) or kernels.packed_columns(b))
    met = list(tiles._by_columns(blocks, told, lambda lo, hi, i, j, code, d: iter([(lo, hi, d.shape)])))
    assert sorted(met) == [(lo, hi, (16, 16)) for lo in range(2) for hi in range(2, 6)] and made == {"ready": 4, "columns": 4}


def test_copies_are_counted_without_their_pairs(spark, monkeypatch):
    """Points met once with how often they are there give the counts of all pairs of all copies, in tiles of one block and of two."""
    monkeypatch.setattr(tiles, "TILE", 16)
    rng = np.random.default_rng(6)
    x, copies = rng.integers(-(2**63), 2**63 - 1, (60, 2)), np.where(np.arange(60) % 5, 1, np.arange(60) % 7 + 1)
    x[9] = x[8]
    points = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, copies))], "pid long, x array<long>, copies long")
    s = space(points, "x", hamming_packed, check=False)
    every = [k for k, c in enumerate(copies) for _ in range(c)]
    want = Counter(int(kernels.packed_rows(x[i : i + 1].copy(), x[j : j + 1])[0]) for k, j in enumerate(every) for i in every[:k])
    for numbered in (True, False):
        t = tiles.distance_tiles(points, s, 60, numbered, ids="copies")
        assert {r.v0: r.cnt for r in tiles.tile_histogram(t, copies=True).collect()} == dict(want)


def test_wide_documents_are_met_once(spark, tmp_path):
    """Equal texts, and null and empty ones, are one point of as many copies; its words are the packed digests."""
    texts = ["one", None, "two", "one", "", "drei \u00fc", "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    s = catalogue.wide_documents(spark, str(tmp_path), distinct=True)
    got = {tuple(r.x): (r.pid, r.copies) for r in s.points.collect()}
    digits = {t: "".join(hashlib.md5(f"{t}:{k}".encode()).hexdigest() for k in range(catalogue.WIDE)) for t in ("one", "", "two", "drei \u00fc")}
    words = {t: spark.range(1).select(pack_symbols(F.lit(d.translate(str.maketrans("0123456789abcdef", catalogue.WIDE_SYMBOLS))))).first()[0] for t, d in digits.items()}
    assert got == {tuple(words["one"]): (0, 3), tuple(words[""]): (1, 2), tuple(words["two"]): (2, 1), tuple(words["drei \u00fc"]): (3, 1)}
    assert s.n_points == 4 and catalogue.wide_documents(spark, str(tmp_path)).n_points == 7


def test_points_that_lie_on_each_other():
    """They don't pull, at whatever place in a tile, and their distance counts as an error."""
    x = np.array([[[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]])
    d = np.array([[1.0, 1.0, 2.0], [1.0, 3.0, 1.0], [2.0, 1.0, 0.0]])
    errors, rows, columns = mds._pulls(d, x, x)
    now = np.linalg.norm(x[0][:, None] - x[0][None], axis=2)
    ratio = np.divide(d, now, out=np.zeros((3, 3)), where=now > 0)
    assert np.allclose(errors, ((now - d) ** 2).sum())
    for got, r in ((rows, ratio), (columns, ratio.T)):
        assert np.allclose(got[0], r.sum(1)[:, None] * x[0] - r @ x[0])


@pytest.mark.parametrize("size", [1024, 7])
def test_tiles_of_every_metric(spark, monkeypatch, size):
    """Kernels give the distances of the column expressions, ties, nulls and NaN of fields included."""
    monkeypatch.setattr(tiles, "TILE", size)
    rng = np.random.default_rng(9)
    seqs = ["".join(x) for x in rng.choice(list("ACGT"), (23, 100))]
    seqs[4] = seqs[3]
    df = spark.createDataFrame([(3 * k, v, rng.integers(0, 3, 70).tolist(), rng.normal(size=5).tolist(), None if k % 5 == 0 else f"b{k % 4}", float("nan") if k % 6 == 0 else k % 3 / 2) for k, v in enumerate(seqs)], "pid long, seq string, v array<int>, e array<double>, a string, f double")
    cases = [
        (space(df.withColumn("w", pack_symbols(F.col("seq"))), F.col("w"), hamming_packed, check=False), "packed"),
        (space(df, "v", "hamming", check=False), "values"),
        (space(df, "e", "euclidean", check=False), "euclidean"),
        (space(df, ["a", "f"], "hamming", check=False), "fields"),
        (space(df, "e", manhattan, check=False), None),
    ]
    for s, name in cases:
        assert getattr(s.metric, "kernel", None) == name
        p = s.points
        want = p.alias("a").join(p.alias("b"), F.col("a.pid") < F.col("b.pid")).select(F.col("a.pid").alias("i"), F.col("b.pid").alias("j"), s.metric(F.col("a.x"), F.col("b.x")).alias("d"))
        got = distributions.all_pairs(p, s)
        assert got.count() == 253 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name


@pytest.mark.parametrize("block_bytes", [128 << 20, 8 * 60 * 5])
def test_wide_points_by_column_blocks(spark, monkeypatch, block_bytes):
    """The histograms of column blocks are those of whole arrays, heavy points and numpy draws included."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(10)
    wide = rng.integers(0, 3, (60, 203))
    wide[7] = wide[8]
    text = ["".join("ACGT"[c] for c in rng.integers(0, 4, 2500)) for _ in range(60)]
    rows = spark.createDataFrame([(k, v.tolist(), t, 1000 if k < 2 else 1) for k, (v, t) in enumerate(zip(wide, text))], "pid long, x array<int>, seq string, w long")
    for coords, metric, weight in (("x", "hamming", None), ("x", "hamming", "w"), (pack_symbols(F.col("seq")), hamming_packed, None)):
        s = space(rows, coords, metric, weight=weight)
        kernel = blocks.blockwise(s)
        assert kernel is not None
        for mode in ("xx", "numpy"):
            got = counts(distributions.distributions(s, ALL, 4, 1500, 7, mode))
            measure = distributions.curvature_measure(s, 4, 200, 7, mode).orderBy("t").collect()
            with monkeypatch.context() as m:
                m.setattr(blocks, "WIDE", 1 << 30)
                assert got == counts(distributions.distributions(s, ALL, 4, 1500, 7, mode))
                assert measure == distributions.curvature_measure(s, 4, 200, 7, mode).orderBy("t").collect()


def test_column_blocks_send_points_that_are_asked_for(spark, monkeypatch):
    """A few tuples of many points send few points, each key to a task of its own; in many pieces the distances are the same."""
    s = space(spark.range(3000).selectExpr("id AS pid", "transform(sequence(1, 70), k -> cast(xxhash64(id, k) % 3 AS int)) AS x"), "x", "hamming", check=False)
    for piece in (blocks.PIECE_BYTES, 8 * 70 * 3):
        monkeypatch.setattr(blocks, "PIECE_BYTES", piece)
        drawn = draws.tuples(s, 2, 0, 50, 3)
        with monkeypatch.context() as m:
            m.setattr(blocks, "WIDE", 1 << 30)
            want = sorted(map(tuple, distributions.with_distances(s, drawn, 2).collect()))
        with_blocks = blocks.block_distances(s, drawn, [(0, 1)], blocks.blockwise(s))
        plan = with_blocks._jdf.queryExecution().toString()
        assert sorted(map(tuple, with_blocks.select(drawn.columns + ["d01"]).collect())) == want
        assert "LeftSemi" in plan and "hashpartitioning(b#" not in plan
    many = draws.tuples(s, 2, 0, 4000, 3)
    assert "LeftSemi" not in blocks.block_distances(s, many, [(0, 1)], blocks.blockwise(s))._jdf.queryExecution().toString()


def test_column_blocks_shuffle_what_they_say(spark, monkeypatch):
    """Bytes a tuple: its ids and one number a pair for each block, whatever the columns in a block."""
    rng = np.random.default_rng(11)
    sent = {}
    for width in (400, 1600):
        s = space(spark.createDataFrame([(k, rng.integers(0, 3, width).tolist()) for k in range(40)], "pid long, x array<int>"), "x", "hamming")
        monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 40 * width // 4)
        drawn = draws.tuples(s, 4, 0, 20_000, 3)
        rows = blocks.block_distances(s, drawn, [(0, 1), (2, 3)], blocks.blockwise(s))
        plan = rows._jdf.queryExecution().executedPlan()
        rows.write.format("noop").mode("overwrite").save()
        sent[width] = rows.count()
        assert "BroadcastHashJoin" not in plan.toString() and "SortMergeJoin" not in plan.toString()
    assert sent == {400: 20_000, 1600: 20_000}


def test_sequences(spark):
    rows = draws.sequences(spark, [0.7, 0.2, 0.1], 50, 200, 9).collect()
    share = np.bincount(np.array([r.symbols for r in rows]).ravel(), minlength=3) / 10000
    assert abs(share - [0.7, 0.2, 0.1]).max() < 0.02


def test_stages_run_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "r")
    assert tables.read_if_there(spark, path) is None
    for _ in range(2):
        assert tables.once(spark, path, make).count() == 3
    assert len(calls) == 1 and tables.read_if_there(spark, path).count() == 3
    h = spark.createDataFrame([("2021-01-01", "f", 0.0, 3), ("2021-01-01", "f", 1.0, 1)], "cutoff string, invariant string, v0 double, cnt long")
    tables.write_slices(h, h.select("cutoff").distinct(), str(tmp_path / "s"))
    got, meta = tables.read_slices(spark, str(tmp_path / "s"))
    assert sorted(r.prob for r in got.collect()) == [0.25, 0.75] and meta.count() == 1


def test_streamed_histogram_is_the_batch_one(spark, symbols, tmp_path):
    spark.range(500).withColumnRenamed("id", "t").write.parquet(str(tmp_path / "t"))
    numbers = spark.readStream.schema("t long").parquet(str(tmp_path / "t"))
    q = streamed.streamed_distributions(numbers, symbols, ALL, 4, 7).writeStream.format("memory").queryName("hist").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert counts(spark.table("hist")) == counts(distributions.distributions(symbols, ALL, 4, 500, 7))


def test_windowed_histogram_with_late_rows(spark, tmp_path):
    """Windows close behind the watermark, and rows that come later than that are dropped."""
    at = lambda minute, second=0: datetime.datetime(2024, 1, 1, 10, minute, second)
    batches = [[(at(0), 1.0), (at(0, 30), 1.0), (at(1), 2.0)], [(at(0, 45), 1.0), (at(9), 5.0)], [(at(0, 50), 1.0), (at(20), 7.0)], [(at(21), 7.0)]]
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = None
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        (part,) = (tmp_path / f"b{k}").glob("part-*.parquet")
        part.rename(tmp_path / "in" / f"{k}.parquet")
        q = q or streamed.windowed_histogram(rows, "v", "ts", "1 minute", "2 minutes").writeStream.format("memory").queryName("windows").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    got = {(r.m, r.v0, r.cnt) for r in spark.table("windows").selectExpr("minute(window.start) AS m", "v0", "cnt").collect()}
    assert got == {(0, 1.0, 3), (1, 2.0, 1), (9, 5.0, 1)}
