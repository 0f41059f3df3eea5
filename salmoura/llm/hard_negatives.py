"""Hard negatives by length buckets and sorted coordinate lists (after LEMP).

All vectors are put into an index: buckets of similar length (each a tenth shorter than the next), cut into chunks of bounded
size. A chunk holds, for each coordinate, the order of its vectors by that coordinate of their direction. A search for
scores of at least t in a chunk of lengths up to l asks for directions within the angle arccos(t / (|a| l)) of the anchor's;
on a focus coordinate (the anchor's largest ones) such a direction must lie in a feasible range, found by binary search in the
sorted list. The shortest range's vectors are intersected with the other focus coordinates' ranges, and what remains is
scored exactly. Chunks whose longest vector cannot reach t are skipped. Where the ranges leave most of a chunk, its scores
are computed as one product instead; both ways verify exactly and give the same rows.

Chunks and anchors meet in a grid of cells. t is the k-th best score found so far: a first pass over one cell of each row
of the grid gives every anchor a bound for the pass over all cells. Two searches run: the positives (same label, best
k of all), then the negatives (other labels) for the score window of each positive.

Defined results: vectors that are null or hold null or non-finite components, and rows without id or label, take no part;
"other" rows have another id; rows repeating an id are positives, negatives and anchors of their own; an empty
vector scores 0; vectors of unlike lengths are compared over the shorter one; an anchor without positives gives no row, nor
does a window that no row meets; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura.llm.common import batched, forget, written
from salmoura.llm.vectors import (
    SCHEMA, Vectors, block_row, comparable, grid, met, packed, products, unpacked, whole_rows,
)
from salmoura.names import col

RATIO = 0.9        # of the lengths of neighbouring buckets
CHUNK = 2048       # vectors of a chunk of the index, at most
HELD = 1 << 15     # vectors that wait for their chunk to fill, in a task
FOCUS = 5          # focus coordinates of an anchor
LISTED = 2         # a chunk is scored as a whole where the shortest ranges hold more than one vector in so many,
DENSE = 8          # or where their intersections do
PAIRS = 1 << 16    # pairs verified at a time
_INDEX = SCHEMA + ", bucket int, orders binary"
_FOUND = "block long, place int, w int, vec_id long, score long"
_WINDOWS = "array<struct<place:int,w:int,low:bigint,high:bigint,reached:bigint>>"
_LEAST, _MOST = -(1 << 62), 1 << 62


def indexed(vectors: DataFrame, scale: int, vec_id: Column, vector: Column, label: Column) -> DataFrame:
    """The index: chunks of vectors of one length bucket, with the order of each coordinate. Write it before it is used."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}
        held = 0

        def chunk(key: tuple[int, int]) -> dict:
            nonlocal held
            parts = waiting.pop(key)
            ids, labels, values = (np.concatenate([p[i] for p in parts]) for i in range(3))
            held -= len(ids)
            row = block_row(int(np.random.default_rng().integers(0, 1 << 62)), ids, labels, values)
            lengths = np.sqrt((values * values).sum(axis=1))
            directions = values / np.where(lengths > 0, lengths, 1.0)[:, None]
            return row | {"bucket": key[1], "orders": np.argsort(directions, axis=0, kind="stable").T.astype(np.uint16).tobytes()}

        def batch_of(row: dict) -> pa.RecordBatch:
            names = ["block", "n", "dim", "norm", "least", "ids", "labels", "data", "bucket", "orders"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 3, pa.int32(), pa.binary()]
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(names, kinds))))

        for batch in batches:
            for ids, labels, values in whole_rows(batch, scale):
                lengths = np.sqrt((values * values).sum(axis=1))
                with np.errstate(divide="ignore"):
                    bucket = np.floor(np.log(lengths) / -np.log(RATIO))
                bucket = np.where(lengths > 0, bucket, -1e9).astype(np.int64)
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    key = (values.shape[1], int(b))
                    for start in range(0, len(at), CHUNK):
                        some = at[start : start + CHUNK]
                        if sum(len(p[0]) for p in waiting.get(key, ())) + len(some) > CHUNK:
                            yield batch_of(chunk(key))
                        waiting.setdefault(key, []).append((ids[some], labels[some], values[some]))
                        held += len(some)
                    while held > HELD:
                        yield batch_of(chunk(max(waiting, key=lambda x: sum(len(p[0]) for p in waiting[x]))))
        for key in list(waiting):
            yield batch_of(chunk(key))

    three = vectors.select(vec_id.cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.alias("vector"))
    return batched(three).mapInArrow(build, _INDEX)


class Chunk:
    """A chunk of the index, ready for searches."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        kind = np.int16 if len(row["data"]) == 2 * n * dim else np.float64
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        data = np.frombuffer(row["data"], kind).reshape(n, dim).astype(np.float64)
        self.longest, self.shortest = row["norm"], row["least"]
        lengths = np.sqrt((data * data).sum(axis=1))
        self.directions = data / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.orders = np.frombuffer(row["orders"], np.uint16).reshape(dim, n)
        self.lists = np.take_along_axis(self.directions.T, self.orders.astype(np.int64), axis=1)  # ascending, per coordinate
        self.vectors = Vectors(self.ids, self.labels, data, None, None)

    def feasible(self, anchors: np.ndarray, lengths: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (anchor, vector) that can have a score of ``reach``; None if a product with all is as cheap.

        Anchors of another length, zero vectors and thresholds that say nothing leave everything possible.
        """
        n, dim = self.directions.shape
        if not dim or anchors.shape[1] != dim or self.shortest <= 0:
            return None
        most = np.where(reach >= 0, self.longest, self.shortest) * lengths
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(most > 0, reach / most, -1.0) - 1e-9
        live = np.flatnonzero((cosine <= 1) & ((lengths > 0) | (reach <= 0)))
        if not len(live):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        angle = np.arccos(np.clip(cosine[live], -1.0, 1.0))
        directions = anchors[live] / np.where(lengths[live] > 0, lengths[live], 1.0)[:, None]
        focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
        own = np.arccos(np.clip(np.take_along_axis(directions, focus, axis=1), -1.0, 1.0))
        low = np.cos(np.minimum(np.pi, own + angle[:, None])) - 1e-9
        high = np.cos(np.maximum(0.0, own - angle[:, None])) + 1e-9
        begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(self.lists[f], low[at], "left")
            end[at] = np.searchsorted(self.lists[f], high[at], "right")
        count = np.maximum(end - begin, 0)
        best = count.argmin(axis=1)
        row = np.arange(len(live))
        sizes = count[row, best]
        if sizes.sum() * LISTED > len(anchors) * n:
            return None
        which = np.repeat(row, sizes)
        first = np.repeat(begin[row, best], sizes)
        step = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = self.orders[focus[which, best[which]], first + step].astype(np.int64)
        for j in range(focus.shape[1]):
            value = self.directions[at, focus[which, j]]
            inside = (value >= low[which, j]) & (value <= high[which, j])
            which, at = which[inside], at[inside]
        return None if len(which) * DENSE > len(anchors) * n else (live[which], at)


def _verified(anchors: np.ndarray, data: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(which), np.int64)
    for start in range(0, len(which), PAIRS):
        some = slice(start, start + PAIRS)
        out[some] = (anchors[which[some]] * data[at[some]]).sum(axis=1).astype(np.int64)
    return out


class Best:
    """The best k (score, then smallest id) of each (anchor, window), and the bound that they give."""

    def __init__(self, low: np.ndarray, high: np.ndarray, reached: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.bound = np.maximum(low, reached)  # scores below it are of no use
        self.row = self.w = self.score = self.id = np.empty(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        parts = [(self.row, self.w, self.score, self.id)]
        for w in range(self.low.shape[1]):
            fits = (score >= self.bound[row, w]) & (score <= self.high[row, w])
            parts.append((row[fits], np.full(int(fits.sum()), w), score[fits], ids[fits]))
        if sum(len(p[0]) for p in parts[1:]) == 0:
            return
        row, w, score, ids = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((ids, -score, w, row))
        row, w, score, ids = row[order], w[order], score[order], ids[order]
        group = row * self.low.shape[1] + w
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        full = place == self.k - 1
        self.bound[row[full], w[full]] = np.maximum(self.bound[row[full], w[full]], score[full])
        self.row, self.w, self.score, self.id = row[kept], w[kept], score[kept], ids[kept]


def _searching(k: int, same: bool):
    """The best k of a cell for each window of its anchors, among vectors of the same label or of others."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks = sorted((Chunk(r) for r in right.to_pylist()), key=lambda c: -c.longest)
        windows: dict[tuple[int, int], list] = {}
        for r in left.select(["block", "state"]).to_pylist():
            for s in r["state"] or ():
                windows.setdefault((r["block"], s["place"]), []).append(s)
        out = []
        sides = unpacked(left)
        comparable(sides, [c.vectors for c in chunks])
        for anchors in sides:
            keys = list(zip(anchors.block.tolist(), anchors.place.tolist()))
            wide = max([s["w"] + 1 for key in keys for s in windows.get(key, ())], default=0)
            asked = np.flatnonzero([key in windows for key in keys])
            low, high = np.full((len(asked), wide), _MOST), np.full((len(asked), wide), _LEAST)
            reached = low.copy()
            for i, a in enumerate(asked):
                for s in windows[keys[a]]:
                    low[i, s["w"]], high[i, s["w"]], reached[i, s["w"]] = s["low"], s["high"], s["reached"]
            data, ids, labels = anchors.data[asked], anchors.ids[asked], anchors.labels[asked]
            lengths = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
            best = Best(low, high, reached, k)
            step = max(1, (1 << 21) // CHUNK)
            for c in chunks:
                for at in range(0, len(asked), step):
                    some = np.arange(at, min(at + step, len(asked)))
                    pairs = c.feasible(data[some].astype(np.float64), lengths[some], best.bound[some].min(axis=1).astype(np.float64))
                    if pairs is None:
                        scores = products(data[some], c.vectors.data).astype(np.int64)
                        which, of = np.nonzero(scores >= best.bound[some].min(axis=1)[:, None])
                        score = scores[which, of]
                    else:
                        which, of = pairs
                        score = _verified(data[some], c.vectors.data, which, of)
                    which = which + at
                    fits = (labels[which] == c.labels[of]) == same
                    fits &= ids[which] != c.ids[of]
                    best.add(which[fits], score[fits], c.ids[of[fits]])
            row = asked[best.row]
            out.append(pa.table({
                "block": anchors.block[row], "place": anchors.place[row].astype(np.int32),
                "w": best.w.astype(np.int32), "vec_id": best.id, "score": best.score,
            }))
        if out:
            return pa.concat_tables(out)
        return pa.table({c: pa.array([], t) for c, t in zip(
            ("block", "place", "w", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))})

    return search


def _with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    grouped = windows.groupBy("block").agg(F.collect_list(F.struct("place", "w", "low", "high", "reached")).alias("state"))
    return anchors.join(grouped.select("block", F.col("state").cast(_WINDOWS)), "block")  # bounded by the block's size


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("block", "place", "w").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best(anchors: DataFrame, index: DataFrame, windows: DataFrame, rows: int, columns: int, k: int, same: bool) -> tuple[DataFrame, str]:
    """The best ``k`` for each (block, place, w) of ``windows`` (low, high), written: and their rank."""
    search = _searching(k, same)
    windows = windows.withColumn("reached", F.lit(_LEAST).cast("bigint"))
    if columns > 1:  # a bound for each window from one cell of each row of the grid
        first = met(_with_windows(anchors, windows), index, rows, columns, search, _FOUND, diagonal=True)
        bound = _top(first, k).filter(F.col("rank") == k).select("block", "place", "w", F.col("score").alias("reached"))
        windows, at = written(windows.drop("reached").join(bound, ["block", "place", "w"], "left").withColumn(
            "reached", F.coalesce("reached", F.lit(_LEAST).cast("bigint"))))
    found, path = written(_top(met(_with_windows(anchors, windows), index, rows, columns, search, _FOUND), k))
    if columns > 1:
        forget(anchors.sparkSession, at)
    return found, path


def mined(
    anchors: DataFrame, vectors: DataFrame, *, positives: int = 5, negatives: int = 10, scale: int = 256,
    least: int = 30, most: int = 90, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Per anchor and positive the best ``negatives`` rows of other labels whose score is ``least`` to ``most`` percent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = anchors.sparkSession
    asked, asked_at = written(packed(anchors, scale, col(vec_id), col(vector), col(label)))
    index, index_at = written(indexed(vectors, scale, col(vec_id), col(vector), col(label)))
    many, all_ = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (asked, index))
    rows, columns = grid(spark, many, all_)

    places = asked.select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    whole = places.select("block", "place", F.lit(0).alias("w"), F.lit(_LEAST).cast("bigint").alias("low"), F.lit(_MOST).cast("bigint").alias("high"))
    near, near_at = _best(asked, index, whole, rows, columns, positives, same=True)
    near = near.select("block", "place", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # least * p <= 100 * s <= most * p, in whole numbers
    p = F.col("positive_score")
    windows = near.select(
        "block", "place", "w", (-F.expr(f"floor((CAST({-least} AS DECIMAL(20)) * positive_score) / 100)")).cast("bigint").alias("low"),
        F.expr(f"floor((CAST({most} AS DECIMAL(20)) * positive_score) / 100)").cast("bigint").alias("high"),
    ).filter("low <= high").filter(p.isNotNull())
    found, found_at = _best(asked, index, windows, rows, columns, negatives, same=False)

    # ids of the anchors by block and place
    ids = asked.select("block", "ids").mapInArrow(_named, "block long, place int, anchor_id long")
    result, _ = written(
        found.join(near, ["block", "place", "w"]).join(ids, ["block", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
    forget(spark, asked_at, index_at, near_at, found_at)
    return result


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), block)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)],
                names=["block", "place", "anchor_id"],
            )
