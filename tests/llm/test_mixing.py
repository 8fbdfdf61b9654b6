import itertools
import random

import numpy as np
import pytest

from tesserae.llm import mixing


def plain_targets(sizes, weights, cap=3.0):
    """Shares by weight; those above the cap stop there and the rest is shared anew, until none is above."""
    out, active, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[k] for k in active)
        over = [k for k in active if rest * weights[k] / total > cap * sizes[k]]
        if not over:
            for k in active:
                out[k] = rest * weights[k] / total
            break
        for k in over:
            out[k] = cap * sizes[k]
        rest -= sum(out[k] for k in over)
        active = [k for k in active if k not in over]
    return out


def test_targets_share_by_weight_and_stop_at_the_cap(spark):
    rng = random.Random(2)
    cases = [([100, 100, 1], [1, 2, 3]), ([5, 0, 7, 1], [1, 2, 3, 1]), ([1, 1, 1], [1, 1, 1]), ([0, 0], [1, 2]), ([1], [3])]
    cases += [([int(rng.paretovariate(0.5)) for _ in range(n)], [[1, 2, 3][k % 3] for k in range(n)]) for n in (7, 40)]
    for sizes, weights in cases:
        df = spark.createDataFrame([(k, s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))], "k long, words long, weight double")
        got = [r.target for r in mixing.targets(df).orderBy("k").collect()]
        assert got == pytest.approx(plain_targets(sizes, weights)) and sum(got) == pytest.approx(sum(sizes))


def test_fitted_is_the_nearest_subset():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randrange(0, 30) for _ in range(rng.randrange(1, 9))]
        goal = rng.random() * sum(words)
        take = mixing.fitted(words, goal)
        got = sum(w for w, t in zip(words, take) if t)
        best = min(abs(sum(c) - goal) for r in range(len(words) + 1) for c in itertools.combinations(words, r))
        assert abs(got - goal) == pytest.approx(best)
        assert not any(t for w, t in zip(words, take) if w == 0)


def test_fitted_leaves_out_a_very_long_item():
    assert mixing.fitted([5_000_000, 3, 4], 7.0) == [False, True, True]


def test_tree_deals_every_draw_to_one_shard():
    quotas, n = np.array([37, 0, 5, 101, 1]), 7
    at = np.zeros_like(quotas)
    for s, units, before, own in mixing.shard_quotas(quotas, n, np.arange(n), 5):
        assert (before == at[units]).all() and (own > 0).all()
        assert own.sum() == quotas.sum() * (s + 1) // n - quotas.sum() * s // n
        at[units] += own
        (alone,) = mixing.shard_quotas(quotas, n, np.array([s]), 5)
        assert alone[0] == s and (alone[3] == own).all()
    assert (at == quotas).all()


def checked(spark, rows, **options):
    """The plan against own sums: sizes, sources, targets, bounds, and words near the targets."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df, **options).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(names, plain_targets([sizes[n] for n in names], [[1, 2, 3][k % 3] for k in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and len(r.draws) <= 3
        taken[r.source] += len(r.draws) * r.size * r.copies
    assert sum(r.copies for r in plan) == len(rows)
    return plan, {n: taken[n] - goal[n] for n in names}


def test_many_sources_share_units(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(1, 9))), f"host{i % 300}" if i % 3 else "big") for i in range(1500)]
    few = checked(spark, rows, block_words=4, shard_blocks=4)
    monkeypatch.setattr(mixing, "MAX_UNITS", 60)
    again, off = checked(spark, rows, block_words=4, shard_blocks=4)
    assert {(r.id, len(r.draws)) for r in again} == {(r.id, len(r.draws)) for r in few[0]} and max(map(abs, off.values())) <= 8


def test_columns_of_any_name_pass_through(spark):
    names = ["mix_key", "mix_hash", "mix_draw", "mix_id", "mix_source", "mix_order", "mix_of", "mix_code", "__k", "id", "hash", "k", "place", "draws"]
    df = spark.createDataFrame([(i, f"a b c {i}", "s", *[f"{n}{i}" for n in names]) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == 30
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_plan_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), ["a", "b", None, "c"][i % 4]) for i in range(400)]
    rows += [(7, "one two three", "a"), (7, "one two three", "a"), (None, "x y", "b"), (9000, None, "c"), (9001, "", None)]
    rows.append((9002, "very " * 300_000 + "long", "b"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [checked(spark, rows, block_words=256, shard_blocks=4) for _ in range(2)]
    assert sorted(map(str, got[0][0])) == sorted(map(str, got[1][0]))
    assert all(abs(d) <= 60 or s == "b" for s, d in got[0][1].items()), got[0][1]
    mixed = mixing.mix(df.withColumn("k", df.doc_id), block_words=256, shard_blocks=4)
    assert mixed.columns == ["doc_id", "text", "source", "k"]
    assert mixed.count() == sum(len(r.draws) * r.copies for r in got[0][0])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan_mix(df).count() == 0 and mixing.mix(df).count() == 0
