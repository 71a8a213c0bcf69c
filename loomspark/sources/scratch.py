"""The package on executors, intermediate tables in the folder that driver and executors share, and paths in any store that Spark reaches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-machine session may leave the setting out.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/loomspark"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before; the folder stays
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there, and executors may be lost."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_at_exit, spark, path)
    for kept in _scratches:
        kept.append(path)
    return path


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end: for results that are written themselves there."""
    kept: list[str] = []
    _scratches.append(kept)
    try:
        yield
    finally:
        _scratches.pop()
        for path in kept:
            remove(spark, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), os.path.basename(root) + ".zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
