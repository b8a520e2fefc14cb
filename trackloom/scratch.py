"""Shared scratch space: tables written to cut lineage.

Everything goes to the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent and Spark runs on this machine alone (tests) is a
folder made here; a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, set as checkpoint folder of the context if it was not."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and forget how it was made.

    Not by checkpoint(): what that returns keeps the size estimated for its plan,
    and in loops these estimates are multiplied until numbers of millions of
    digits occupy the driver.  A table has its true size.
    """
    table, path = written(df, name)
    table._scratch_path = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by ``cut`` that nothing will read again."""
    for table in tables:
        if table is not None and getattr(table, "_scratch_path", None):
            remove(table.sparkSession, table._scratch_path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete a query's shuffle files as soon as it ends; the session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def store(df: DataFrame, path: str) -> None:
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; the table and its path."""
    path = new_path(df.sparkSession, name)
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``written``, through the file system of its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
