import itertools
import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from tests.oracle import DATA, same
from tesserae.functions import laws
from tesserae.plans.catalogue import LENGTH, ORACLE_SQL, QUERIES

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in ORACLE_SQL:
        same(spark, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_mds_covers_the_table(spark):
    got = QUERIES["q47_mds_embedding"](spark, DATA).select("pid").distinct().count()
    assert got == spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").distinct().count()


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_laws_of_all_layers(spark):
    """Site laws in closed form where there is one, the rest by enumeration."""
    times, phi = (0.05, 0.1, 0.5, 1.0, math.inf), np.array([0.0, 0.0, -10.0, -10.0])
    rows = {name: [r.asDict() for r in QUERIES[name](spark, DATA).collect()] for name in ("q51_binomial_pmf_all_layers", "q52_pair_sum_law_all_layers", "q53_pattern_law_all_layers", "q54_hyperbolicity_exact_law_all_layers")}
    got = {}
    for name, found in rows.items():
        for r in found:
            own = got.setdefault((name[:3], r.pop("family"), r.pop("time")), {})
            prob = r.pop("prob")
            own[tuple(r.values())] = prob
    rho = {(r.family, r.time): r.rho for r in laws.model_layers(spark).collect()}
    assert {k[1:] for k in got} == {(f, t) for f in ("JC", "HB") for t in times} and len(got) == 40
    for t in times:
        away = 0.0 if t == math.inf else math.exp(-4 * t / 3)
        assert np.allclose(rho["JC", t], [(1 - away) / 4 + away * (s == 0) for s in range(4)])
    assert np.allclose(rho["HB", math.inf], np.exp(phi) / np.exp(phi).sum())
    for layer, r in rho.items():
        one, patterns = Counter(), Counter()
        for w in itertools.product(range(4), repeat=4):
            a, b, c, e = w
            p = math.prod(r[x] for x in w)
            patterns[tuple(int(x != y) for x, y in itertools.combinations(w, 2))] += p
            one[(a != b) + (c != e), (a != c) + (b != e), (a != e) + (b != c)] += p
        law = {(0, 0, 0): 1.0}
        for _ in range(LENGTH):
            step = Counter()
            for x, p in law.items():
                for y, q in one.items():
                    step[x[0] + y[0], x[1] + y[1], x[2] + y[2]] += p * q
            law = step
        deficit = Counter()
        for x, p in law.items():
            top = sorted(x)
            deficit[((top[2] - top[1]) / 2,)] += p
        p = 1 - sum(x * x for x in r)
        binomial = {(v,): math.comb(100, v) * p**v * (1 - p) ** (100 - v) for v in range(101)}
        for name, want in (("q51", binomial), ("q52", one), ("q53", patterns), ("q54", deficit)):
            found = got[name, *layer]
            assert all(abs(found.get(k, 0.0) - want.get(k, 0.0)) < 1e-9 for k in {*found, *want}), (name, layer)


def test_entry_without_the_corpus_parts():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_nothing_else_imports_the_corpus_parts():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tesserae")
    for folder, _, files in os.walk(root):
        if "llm" not in folder.split(os.sep):
            assert not any("tesserae.llm" in open(os.path.join(folder, f)).read() for f in files if f.endswith(".py"))
