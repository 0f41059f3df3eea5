"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, cell by cell of a grid of blocks. A cell keeps no scores: it counts, per
query, how many fall into each of ``BINS`` equal bins of the range that is still open. The counts of all cells are summed
up, the bin that holds the k-th score is found, and the next round divides that bin, until a bin is one whole number: the
k-th score itself, and how many of its ties belong to the result. A last pass then picks the scores above it and, among
the ties, the smallest ids, so that at most k rows a query and cell leave it besides the ties it needs.

A cell's bins below the one in which its own count reaches k cannot hold the k-th score of all, so they are not sent on.
The number of rounds is the logarithm of the range (two for unit vectors in 64ths); state between rounds is two numbers a query.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; a
query's own row is every candidate row with its id; rows repeating an id are candidates, and queries, of their own; an
empty vector scores 0; vectors of unlike lengths are compared over the shorter one; fewer candidates than k give
all; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from salmoura.llm.common import forget, written
from salmoura.llm.vectors import SLICE, Vectors, comparable, grid, met, packed, products, unpacked
from salmoura.names import col

BINS = 256
_STATE = "array<struct<place:int,low:bigint,need:bigint>>"


def _opened(queries: pa.Table, low: int | None, k: int) -> dict[tuple[int, int], tuple[int | None, int]]:
    """(lowest score of the open range, rank wanted in it) by block and place; None: everything is wanted."""
    found = {}
    for row in queries.select(["block", "n", "state"]).to_pylist():
        found |= {(row["block"], i): (low, k) for i in range(row["n"])}
        found |= {(row["block"], s["place"]): (s["low"], s["need"]) for s in row["state"] or ()}
    return found


def _sliced(queries: Vectors, width: int):
    """Ranges of queries whose scores against ``width`` candidates are held at a time."""
    step = max(1, SLICE // max(1, width))
    return (slice(at, at + step) for at in range(0, len(queries.ids), step))


def _counting(low: int, width: int, k: int):
    """Counts per query and bin, from the top down to where the cell's own count reaches the rank wanted."""
    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, candidates = unpacked(left), unpacked(right)
        comparable(queries, candidates)
        opened = _opened(left, low, k)
        out = []
        for q in queries:
            state = [opened[key] for key in zip(q.block.tolist(), q.place.tolist())]
            lows = np.array([s[0] for s in state], np.int64)
            needs = np.array([s[1] for s in state], np.int64)
            total = np.zeros((len(q.ids), BINS), np.int64)
            for c in candidates:
                for some in _sliced(q, len(c.ids)):
                    scores = products(q.data[some], c.data).astype(np.int64)
                    bins = (scores - lows[some, None]) // width
                    bins[(bins < 0) | (bins >= BINS) | (c.ids[None, :] == q.ids[some, None])] = BINS
                    rows = len(bins)
                    bins += np.arange(rows)[:, None] * (BINS + 1)
                    total[some] += np.bincount(bins.ravel(), minlength=rows * (BINS + 1)).reshape(rows, -1)[:, :BINS]
            above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            at, which = np.nonzero((total > 0) & (above < needs[:, None]))
            out.append(pa.table({
                "block": q.block[at], "place": q.place[at].astype(np.int32), "need": needs[at],
                "low": lows[at] + which * width, "n": total[at, which],
            }))
        return pa.concat_tables(out) if out else _nothing("block place need low n", "place")

    return count


def _nothing(names: str, small: str = "") -> pa.Table:
    return pa.table({c: pa.array([], pa.int32() if c in small.split() else pa.int64()) for c in names.split()})


def _picking(k: int):
    """Scores above the k-th, and of its ties the smallest ids."""
    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, candidates = unpacked(left), unpacked(right)
        comparable(queries, candidates)
        opened = _opened(left, None, k)
        out = []
        for q in queries:
            state = [opened[key] for key in zip(q.block.tolist(), q.place.tolist())]
            lowest = np.iinfo(np.int64).min
            kth = np.array([lowest if s[0] is None else s[0] for s in state], np.int64)
            needs = np.array([s[1] for s in state], np.int64)
            for c in candidates:
                for some in _sliced(q, len(c.ids)):
                    scores = products(q.data[some], c.data).astype(np.int64)
                    other = c.ids[None, :] != q.ids[some, None]
                    at, of = np.nonzero((scores > kth[some, None]) & other)
                    tied_at, tied_of = np.nonzero((scores == kth[some, None]) & other)  # ids ascend
                    first = np.searchsorted(tied_at, tied_at)
                    few = np.arange(len(tied_at)) - first < needs[some][tied_at]
                    at, of = np.concatenate([at, tied_at[few]]), np.concatenate([of, tied_of[few]])
                    row = at + some.start
                    out.append(pa.table({
                        "block": q.block[row], "place": q.place[row].astype(np.int32), "query_id": q.ids[row],
                        "vec_id": c.ids[of], "score": scores[at, of],
                    }))
        return pa.concat_tables(out) if out else _nothing("block place query_id vec_id score", "place")

    return pick


def nearest(
    queries: DataFrame, candidates: DataFrame, *, k: int = 20, scale: int = 64, vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Per query its ``k`` best candidates by inner product of floor(scale * x): query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    asked, asked_at = written(packed(queries, scale, col(vec_id), col(vector)))
    known, known_at = written(packed(candidates, scale, col(vec_id), col(vector)))
    many, longest = asked.agg(F.sum("n"), F.max("norm")).first()
    all_, farthest = known.agg(F.sum("n"), F.max("norm")).first()
    rows, columns = grid(spark, many or 0, all_ or 0)

    bound = int((longest or 0.0) * (farthest or 0.0) * (1 + 1e-9)) + 1
    width = 1
    while width * BINS <= 2 * bound:
        width *= BINS
    state, low, gone = None, -bound, []
    while True:
        counts = met(
            _with_state(asked, state), known, rows, columns, _counting(low, width, k),
            "block long, place int, need long, low long, n long",
        ).groupBy("block", "place", "need", "low").agg(F.sum("n").alias("n"))
        # the bin in which the count from the top reaches the rank; fewer than k candidates in all: none
        down = Window.partitionBy("block", "place").orderBy(F.col("low").desc())
        state, at = written(
            counts.withColumn("above", F.sum("n").over(down) - F.col("n"))
            .filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
            .select("block", "place", "low", (F.col("need") - F.col("above")).alias("need"))
        )
        gone.append(at)
        if width == 1:
            break
        width //= BINS
    found = met(
        _with_state(asked, state), known, rows, columns, _picking(k),
        "block long, place int, query_id long, vec_id long, score long",
    )
    best = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    result, _ = written(
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
    forget(spark, asked_at, known_at, *gone)
    return result


def _with_state(asked: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return asked.withColumn("state", F.lit(None).cast(_STATE))
    grouped = state.groupBy("block").agg(F.collect_list(F.struct("place", "low", "need")).alias("state"))
    return asked.join(grouped, "block", "left")  # at most a block's number of entries each
