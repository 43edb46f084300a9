"""Shared scratch tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Scopes of the running thread, so that concurrent callers do not share them.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove, at the end, every scratch table made inside; write the results elsewhere before."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in made:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder_of(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """``(path, None)`` of a folder, ``(its folder, its name)`` of a file, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    if fs.getFileStatus(where).isDirectory():
        return path, None
    return where.getParent().toString(), where.getName()


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/framelark-{name}-{uuid.uuid4().hex}"
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    return path


def write_through(df: DataFrame, name: str, cluster_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Compute once, store as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.repartition(*cluster_by) if cluster_by else df
    out.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
