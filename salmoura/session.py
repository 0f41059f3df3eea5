"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "salmoura", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution; partition counts are left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call sites are looked up for every column expression otherwise
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # percentile() aggregates by object hash; the default of 128 groups sorts too early
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8192")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must reach it, so there is no substitute where none is named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    path = f"{root.rstrip('/')}/salmoura-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the shared folders that were asked for inside. For jobs that write all their results."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used before work that passes over the same rows many times (model fits), so
    a lost executor re-reads files instead of running the whole plan again.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
