"""Folders that driver and executors share, tables written there, and the package on the workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which all executors see.

    Where that setting is missing, the folder is below the warehouse; only a
    session of one machine (master ``local``) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if (spark.conf.get("spark.master", None) or "").startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    if ":/" not in base:
        base = "file://" + base
    return f"{base.rstrip('/')}/tesserae/{kind}-{uuid.uuid4().hex}"


#: Of each open ``scratch``, the folders that ``stored`` wrote within it.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it back: lineage ends there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, kind)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``stored`` writes within are removed at its end.

    Gives a function that stores a table to stay: results must come from such
    tables alone.
    """
    held: list[str] = []

    def keep(df: DataFrame, kind: str) -> DataFrame:
        out = stored(df, kind)
        path = held.pop()
        if len(_OPEN) > 1:  # now it is one of the tables of the scratch around this one
            _OPEN[-2].append(path)
        return out

    _OPEN.append(held)
    try:
        yield keep
    finally:
        _OPEN.remove(held)
        for path in held:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shipped(spark: SparkSession) -> None:
    """Let Python workers import this package: once a session it goes out as an archive."""
    context = spark.sparkContext
    if "TESSERAE_SHIPPED" in context.environment:
        return
    context.environment["TESSERAE_SHIPPED"] = "1"
    if context.master.startswith("local"):
        context.environment.setdefault("PYTHONPATH", str(PACKAGE.parent))
        return
    path = Path(tempfile.mkdtemp(prefix="tesserae-package-")) / "tesserae_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(f.relative_to(PACKAGE.parent)))
    context.addPyFile(str(path))
