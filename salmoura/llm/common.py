"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salmoura.names import col
from salmoura.session import shared_folder

BROADCAST_ROWS = 500_000  # a table of ids is broadcast up to this many counted rows
ARROW_ROWS = 1_000          # rows of texts sent to Python at a time
SLICE = 256                 # rows handled at a time inside a task
SLICE_BYTES = 1 << 20       # and bytes of text, where arrays many times their size are made of them


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def batched(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """``df``, whose rows will go to Python in batches of at most ``rows``: texts are long, and a batch of Spark's default
    of 10,000 of them takes memory outside of the heap. A setting of the session's own is kept."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "10000") == "10000":
        conf.set(key, str(rows))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of rows and bytes of text; a longer text is a slice of its own."""
    for batch in slices(batches):
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, length in enumerate(lengths):
            if i > start and total + length > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += length
        if lengths:
            yield batch.slice(start)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path (for ``forget``)."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove folders of :func:`written` that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where ``df`` (already written, one or two numbers a row) is counted to hold at
    most ``rows`` rows; larger tables are left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of ``links`` (a, b): (id, component), component the smallest id reached.

    Each round takes the smallest label among the neighbours, then the label of that label, so that
    long chains halve. Labels are written each round; the returned path can be forgotten.
    """
    spark = links.sparkSession
    pairs = links.filter("a <> b")
    edges, edges_at = written(
        pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct()
    )
    start = edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component"))
    labels, at = written(start)
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("_near"))
        )
        lower, lower_at = written(
            labels.join(near, "id").select(
                "id", F.least("component", "_near").alias("component"),
                (F.col("_near") < F.col("component")).alias("_changed"),
            )
        )
        changed = lower.filter("_changed").limit(1).count()
        if not changed:
            forget(spark, lower_at, edges_at)
            return labels, at
        of = lower.select(F.col("id").alias("component"), F.col("component").alias("_of"))
        next_labels, next_at = written(
            lower.join(of, "component").select("id", F.col("_of").alias("component"))
        )
        forget(spark, at, lower_at)
        labels, at = next_labels, next_at


def columns_of(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]
