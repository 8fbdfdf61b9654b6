"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tesserae.llm import queries, resampling
from tests.llm.test_texts import frame, texts
from tests.oracle import same

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(k, t) for k, t in enumerate([*texts(), "long words " * 30_000, "İÀß9a b_c", *texts()[20:40]])] + [(7, "x y " * 20), (7, "x y " * 20), (7, "x y z " * 20), (None, "alpha beta " * 15), (None, None)]
AIM = ["alpha beta alpha", "Gamma, ÉTÉ été", None, "", "nothing else here"]


def grams(text, lo, hi):
    words = WORDS.findall((text or "").translate(LOW))
    return words, [" ".join(words[k : k + n]) for n in range(lo, hi + 1) for k in range(len(words) - n + 1)]


def plain(rows, aim, lo=1, hi=1, buckets=10_000, percent=10, least=20, seed=2024):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    own = [grams(t, lo, hi) for _, t in rows]
    s = Counter(bucket(g) for _, gs in own for g in gs)
    t = Counter(bucket(g) for x in aim for g in grams(x, lo, hi)[1])
    top = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (key, _), (words, gs) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(top[bucket(g)] for g in gs) // len(gs) if gs else 0
        out.append([key, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("split", "percent", "lo", "hi"), [(1 << 20, 10, 1, 1), (0, 50, 1, 1), (1, 90, 1, 1), (1, 100, 2, 3), (2, 40, 1, 2)])
def test_ranks(spark, monkeypatch, split, percent, lo, hi):
    monkeypatch.setattr(resampling, "SPLIT", split)  # 0: every score is numbered by ranges
    if split:
        monkeypatch.setattr(resampling, "noise", lambda key, seed: resampling.F.pmod(resampling.F.hash(key), resampling.F.lit(3)).cast("long"))
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(AIM)], "item_id long, text string")
    got = [tuple(r) for r in resampling.importance_ranks(frame(spark, ROWS), aim, percent=percent, lo=lo, hi=hi).collect()]
    want = plain(ROWS, AIM, lo, hi, percent=percent)
    if not split:
        assert Counter(got) == want
        return
    # Many ties: weights as in the plain version, and ranks in the stated order.
    assert Counter(r[:3] for r in got) == Counter(k[:3] for k in want.elements())
    ranked = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) == len([k for k in want.elements() if k[4]])
    assert [r[:4] for r in ranked] == [r[:4] for r in sorted(ranked, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))]
    least, short = min(r[3] for r in ranked), {k for k, t in ROWS if len(grams(t, 1, 1)[0]) < 20}
    assert all(r[4] for r in got if r[3] > least and r[0] not in short)


def test_defined_cases(spark):
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(AIM)], "item_id long, text string")
    assert resampling.importance_ranks(frame(spark, []), aim).collect() == []
    nothing = resampling.importance_ranks(frame(spark, ROWS), aim.limit(0)).collect()
    assert Counter(map(tuple, nothing)) == plain(ROWS, [])
    few = resampling.importance_ranks(frame(spark, [(1, "a b"), (2, None)]), aim).collect()  # none has 20 words
    assert sorted((r.doc_id, r.n_features, r.rank) for r in few) == [(1, 2, None), (2, 0, None)]


def test_resample_keeps_columns(spark):
    df = frame(spark, ROWS)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(AIM)], "item_id long, text string")
    drawn = resampling.resample(df, aim, percent=30)
    assert drawn.columns == df.columns
    want = Counter(k[0] for k in plain(ROWS, AIM, percent=30).elements() if k[4])
    assert Counter(r.doc_id for r in drawn.collect()) == want


def test_op11(spark):
    same(spark, queries.QUERIES["op11_importance_resampling"], queries.ORACLE_SQL["op11_importance_resampling"])
