import numpy as np
from pyspark.sql import functions as F

from tesserae.plans import jobs


def test_display_time():
    assert jobs.display_time(3725.5) == "1:02:05.50" and jobs.display_time(0) == "0:00:00.00"


def test_fasta_to_statistics(spark, tmp_path, capsys):
    rng, lines, k = np.random.default_rng(0), [], 0
    dates = ["2020-04-15", "2021-02-01", "2021-08-01", "2022-01-15", "2023-06-01"]
    base = rng.choice(list("ACGT"), 300)
    for layer, date in enumerate(dates):
        for _ in range(40):
            seq = np.where(rng.random(300) < 0.02 * (layer + 1), rng.choice(list("ACGT"), 300), base)
            lines += [f">v/{k}|E{k:06d}|{date}|x", "".join(seq)]
            k += 1
    lines += [">v/bad|E9|2021-01-01|x", "N" + "A" * 299, ">v/odd|E8|2021-03|x", "A" * 300]
    (tmp_path / "in.fasta").write_text("\n".join(lines) + "\n")
    cutoffs, out = ["2020-06-30", "2021-04-30", "2021-10-31", "2022-03-01", "2024-01-31"], str(tmp_path / "out")
    records, forms = jobs.prepare(spark, str(tmp_path / "in.fasta"), out)
    assert records.count() == 200 and forms.agg(F.sum("multiplicity")).first()[0] == 200
    told = spark.read.parquet(f"{out}/report").first()
    assert (told.records, told.bad_characters, told.no_date, told.gap, told.kept, told.width, told.ungapped_width) == (202, 1, 1, 0, 200, 300, 300)
    got = jobs.run_sequences(spark, str(tmp_path / "in.fasta"), out, cutoffs, n_samples=400).orderBy("cutoff").collect()
    meta = {str(r.cutoff): r for r in spark.read.parquet(f"{out}/slices/metadata").collect()}
    last = meta[cutoffs[-1]]
    assert len(meta) == 5 and len(last) == 29 and (last.n_sites, last.n_samples, last.n_events, last.n, last.p) == (300, 400, 15, 4, 1.0)
    assert last.alpha_event == 1 - 0.05 / 15 and last.epsilon_distance < last.epsilon_persistence and last.runtime_seconds > 0
    assert last.diam == spark.read.parquet(f"{out}/slices/histograms").where(f"cutoff = '{cutoffs[-1]}' AND invariant = 'pairwise_distance'").agg(F.max("v0")).first()[0]
    import shutil

    shutil.rmtree(f"{out}/slices/histograms/cutoff={cutoffs[1]}")  # a slice that is missing is made again, the others stay
    again = jobs.run_sequences(spark, str(tmp_path / "in.fasta"), out, cutoffs, n_samples=400).orderBy("cutoff").collect()
    assert again == got and {str(r.cutoff): r.finished for r in spark.read.parquet(f"{out}/slices/metadata").collect() if str(r.cutoff) != cutoffs[1]} == {k: r.finished for k, r in meta.items() if k != cutoffs[1]}
    assert [r.n_sequences for r in got] == [40, 80, 120, 160, 200]
    assert [r.dist_mean for r in got] == sorted(r.dist_mean for r in got) and all(0 <= r.hyp_p_zero <= 1 for r in got)
    counts = spark.read.parquet(f"{out}/slices/histograms").groupBy("cutoff", "invariant").agg(F.sum("cnt").alias("c")).collect()
    assert len(counts) == 15 and {r.c for r in counts} == {400}
    jobs.main(["summary", out])
    assert "pers_birth_median" in capsys.readouterr().out


def test_model_job(spark, tmp_path):
    jobs.run_model(spark, str(tmp_path), length=12, samples=300, mds_samples=3)
    assert spark.read.parquet(str(tmp_path / "distance")).groupBy("family", "time").agg(F.sum("prob").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert spark.read.parquet(str(tmp_path / "hyperbolicity")).select("family", "time").distinct().count() == 10
    assert {r.s for r in spark.read.parquet(str(tmp_path / "persistence")).groupBy("family", "time").agg(F.sum("cnt").alias("s")).collect()} == {300}
    assert spark.read.parquet(str(tmp_path / "embedding")).count() == 30
    from tesserae.sources import tables

    found = tables.read_model(spark, str(tmp_path))
    assert set(found) == {"distance", "hyperbolicity", "persistence", "embedding"} and tables.read_model(spark, str(tmp_path / "none")) == {}
    assert all(abs(r.s - 1) < 1e-9 for r in found["persistence"].groupBy("family", "time").agg(F.sum("prob").alias("s")).collect())


def test_model_job_embeds_each_family_by_default(spark, tmp_path):
    jobs.run_model(spark, str(tmp_path), length=12, samples=300)
    got = spark.read.parquet(str(tmp_path / "embedding"))
    counts = {(r.family, r.layer_index): r["count"] for r in got.groupBy("family", "layer_index").count().collect()}
    assert counts == {(f, k): 160 for f in ("JC", "HB") for k in range(5)}
    for f in ("JC", "HB"):
        own = got.where(F.col("family") == f)
        assert own.select("pid").distinct().count() == 800 and own.select("stress").distinct().count() == 1
        assert all(abs(x) < 1e-6 for x in own.agg(F.avg("x0"), F.avg("x1")).first())


def test_embedding_of_forms(spark, tmp_path, capsys):
    rng, lines = np.random.default_rng(3), []
    base = rng.choice(list("ACGT"), 60)
    for k in range(30):
        seq = np.where(rng.random(60) < 0.2, rng.choice(list("ACGT"), 60), base)
        lines += [f">v/{k}|E{k:06d}|2021-01-{k + 1:02d}|x", "".join(seq)]
    (tmp_path / "in.fasta").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    records, forms = jobs.prepare(spark, str(tmp_path / "in.fasta"), out)
    first = {r.uid: r.first_seen for r in forms.collect()}
    want = records.where("epi_isl = 'E000013'").first().uid
    for size in (3, 12, 100):
        got = jobs.embed_forms(spark, out, "E000013", max_points=size).collect()
        assert len({r.uid for r in got}) == len(got) == min(size, len(first)) and all(r.first_seen == first[r.uid] for r in got)
        assert [r.uid for r in got if r.is_reference] == [want]
    assert spark.read.csv(f"{out}/mds_embedding_max12", header=True).columns == ["uid", "x", "y", "stress", "first_seen", "is_reference"]
    from tesserae.sources import tables

    assert tables.largest_embedding(spark, out).count() == len(first) and tables.largest_embedding(spark, str(tmp_path / "none")) is None
    assert not any(r.is_reference for r in jobs.embed_forms(spark, out, "none", max_points=5).collect())
    jobs.main(["mds", out, "--reference", "E000013", "--max-points", "4"])
    assert "4 forms embedded" in capsys.readouterr().out
