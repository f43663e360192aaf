"""Helpers shared by the operators: shared scratch tables, shipping this package
to the Python workers, and small column expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}

#: stands for a null id where ids are ordered or joined; below every real id
NULL_ID = -(2**63)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (once per application).

    The sources are zipped and handed to ``addPyFile``, so Spark's own file
    service carries them to every executor, also to those that join later.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where
    the setting is missing and the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="askwell-scratch-")
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls give the same one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, and what follows reads one and the same result however often."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def order_id(col: str = "doc_id") -> Column:
    """The id as it is ordered and joined: null below every other."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``: the same
    rows however ``df`` is partitioned.  Rows that can't be among them are left
    out by a threshold first, so that about ``most`` rows in all move."""
    h = F.xxhash64(key, F.lit(seed))
    n = df.count()
    if n > 2 * most:
        share = 2.0 * most / n
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    order = [F.pmod(h, F.lit(1 << 30)), F.col(key)]
    return df.orderBy(*order).limit(most)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when its query ends, not when the
    driver happens to collect its garbage.  For queries that run once.  A stage that
    Spark drops while it runs (its join turned out empty) may leave files to the latter."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``materialize``; also the folder, for ``remove``."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
