"""Tables in the shared folder."""

import os

import pytest

from tesserae.sources.shared import scratch, stored


def folder(df):
    return df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with scratch(spark) as keep:
        a = stored(spark.range(5), "a")
        with scratch(spark) as keep_inner:
            b = stored(a.selectExpr("id + 1 AS id"), "b")
            c = keep_inner(b, "c")
            gone = folder(b)
        assert not os.path.exists(gone) and os.path.exists(folder(c))
        d = keep(c.selectExpr("sum(id) AS s"), "d")
        paths = [folder(a), folder(c)]
    assert d.first().s == 15 and not any(map(os.path.exists, paths))
    e = stored(spark.range(2), "e")
    with pytest.raises(ZeroDivisionError), scratch(spark):
        path = folder(stored(spark.range(3), "f"))
        1 / 0
    assert not os.path.exists(path) and e.count() == 2
