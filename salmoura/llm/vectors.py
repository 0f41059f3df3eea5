"""Whole-number vectors in blocks, and the grid of cells in which two sets of blocks meet.

A vector takes part if it has an id and no null or non-finite component; each component x becomes floor(scale * x), which
is exact for floats and doubles as long as scale is a power of two. A block holds at most ``BLOCK`` vectors of one
length. Inner products of vectors of different lengths run over the shorter one's components (the rest counts as 0).

Products are exact: in doubles where no sum can reach 2^53, else in 64-bit integers; where a product could reach 2^59
the cell raises an error instead of giving a wrong number.

Two sets meet in a grid: left blocks in ``left`` groups, right blocks in ``right`` groups, each cell one task of bounded
size. The numbers of groups follow from counts, so that cells are many on small inputs and large (fewer copies
of each block) on large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salmoura.llm.common import batched

BLOCK = 256           # vectors of a block
GROUP = 1 << 15       # vectors of a side of a cell, at most (in the mean)
LEAST = 1 << 10       # and at least, where there are as many
SLICE = 1 << 22       # scores held at a time
EXACT, MOST = 2.0**53, 2.0**59
SCHEMA = "block long, n int, dim int, norm double, least double, ids binary, labels binary, data binary"


def whole_rows(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, floor(scale * x) as doubles) of the rows that take part, for each length; columns: id, label, vector."""
    lists = batch.column(2)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    labels = batch.column(1).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    usable = np.ones(batch.num_rows, bool)
    for c in batch.columns:
        usable &= c.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths[usable]):
        at = np.flatnonzero(usable & (lengths == dim))
        values = flat[offsets[at][:, None] + np.arange(dim)]
        fine = np.isfinite(values).all(axis=1)
        if fine.any():
            with np.errstate(over="ignore"):
                out = np.floor(values[fine] * float(scale))
            yield ids[at][fine].astype(np.int64), labels[at][fine].astype(np.int64), out


def block_row(number: int, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> dict:
    norms = np.sqrt((values * values).sum(axis=1))
    small = not values.size or np.abs(values).max() < 1 << 15
    return {
        "block": number, "n": len(ids), "dim": values.shape[1], "norm": float(norms.max()), "least": float(norms.min()),
        "ids": ids.tobytes(), "labels": labels.tobytes(), "data": values.astype(np.int16 if small else np.float64).tobytes(),
    }


def packed(vectors: DataFrame, scale: int, vec_id: Column, vector: Column, label: Column | None = None) -> DataFrame:
    """Blocks of the vectors that take part (``SCHEMA``). Block numbers are hashes; write the result before it is used twice."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = []
            for ids, labels, values in whole_rows(batch, scale):
                for at in range(0, len(ids), BLOCK):
                    number = int(np.random.default_rng().integers(0, 1 << 62))
                    rows.append(block_row(number, ids[at : at + BLOCK], labels[at : at + BLOCK], values[at : at + BLOCK]))
            if rows:
                schema = schema or pa.Table.from_pylist(rows[:1]).schema
                yield pa.RecordBatch.from_pylist(
                    rows, schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()),
                                            ("norm", pa.float64()), ("least", pa.float64()), ("ids", pa.binary()),
                                            ("labels", pa.binary()), ("data", pa.binary())]))

    three = vectors.select(
        vec_id.cast("bigint").alias("id"), (F.lit(0) if label is None else label).cast("bigint").alias("label"),
        vector.alias("vector"),
    )
    return batched(three).mapInArrow(pack, SCHEMA)


@dataclass
class Vectors:
    """The vectors of some blocks of one length; rows of ``data`` are doubles or 64-bit integers."""
    ids: np.ndarray
    labels: np.ndarray
    data: np.ndarray
    block: np.ndarray  # number of each vector's block
    place: np.ndarray  # and its place there


def unpacked(table: pa.Table) -> list[Vectors]:
    """The vectors of a cell's side, one entry a length, ascending by id."""
    out = []
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = table.filter(pa.array(dims == dim))
        ids, labels, data, block, place = [], [], [], [], []
        for row in part.select(["block", "n", "ids", "labels", "data"]).to_pylist():
            n = row["n"]
            ids.append(np.frombuffer(row["ids"], np.int64))
            labels.append(np.frombuffer(row["labels"], np.int64))
            kind = np.int16 if len(row["data"]) == 2 * n * dim else np.float64
            data.append(np.frombuffer(row["data"], kind).reshape(n, dim).astype(np.float64))
            block.append(np.full(n, row["block"]))
            place.append(np.arange(n))
        joined = Vectors(*(np.concatenate(x) for x in (ids, labels, data, block, place)))
        order = np.lexsort((joined.place, joined.block, joined.ids))
        out.append(Vectors(*(x[order] for x in (joined.ids, joined.labels, joined.data, joined.block, joined.place))))
    return out


def comparable(left: list[Vectors], right: list[Vectors]) -> None:
    """Make the numbers of both sides doubles or integers, whichever gives exact products."""
    def longest(side: list[Vectors]) -> float:
        return max((float(np.sqrt((v.data * v.data).sum(axis=1)).max()) for v in side if len(v.ids)), default=0.0)

    most = longest(left) * longest(right) * (1 + 1e-9)
    if not most < MOST:
        raise ValueError(f"inner products may reach {most:.3g}, beyond what whole 64-bit numbers hold")
    if most >= EXACT:
        for v in (*left, *right):
            v.data = v.data.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, as far as the shorter rows go."""
    dim = min(a.shape[1], b.shape[1])
    return a[:, :dim] @ b[:, :dim].T


def grid(spark, left: int, right: int) -> tuple[int, int]:
    """Numbers of groups of both sides for so many vectors."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    columns = max(1, -(-right // GROUP), min(tasks, -(-right // LEAST)))
    rows = max(1, -(-left // GROUP), min(-(-tasks // columns), -(-left // LEAST)))
    return rows, columns


def group_of(block: str, groups: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.col(block), F.lit(salt)), F.lit(groups)).cast("int")


def met(left: DataFrame, right: DataFrame, rows: int, columns: int, work, schema: str, diagonal: bool = False) -> DataFrame:
    """``work(left blocks, right blocks)`` in each cell of the grid; with ``diagonal`` in one cell a row of it."""
    left = left.withColumn("_row", group_of("block", rows, "left"))
    right = right.withColumn("_column", group_of("block", columns, "right"))
    if diagonal:
        left = left.withColumn("_column", F.col("_row") % columns)
        right = right.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).filter(
            F.col("_row") % columns == F.col("_column"))
    else:
        left = left.withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        right = right.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cell = ["_row", "_column"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(work, schema)
