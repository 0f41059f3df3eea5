"""Convex hull of a large point set and the test of points against it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura import names as N
from salmoura.functions.columns import all_positive
from salmoura.operators.cleaning import complete_cases
from salmoura.session import materialise

# the few functions below that run in Python workers are sent there by value, so that
# the package need not be installed on every machine
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-9
DIRECTIONS = 64  # sides worked out separately
STRIPS = 256     # of a polygon that points are compared with
POINT = "x double, y double"

# fixed values: the pairs of variables that are compared
SIMILARITY_PAIRS = {
    "BARIO_ESTRONCIO": ("MEDIANA_BARIO_PLAT", "MEDIANA_ESTRONCIO_PLAT"),
    "SALINIDADE_BARIO": ("MEDIANA_SALINIDADE_PLAT", "MEDIANA_BARIO_PLAT"),
    "SALINIDADE_ESTRONCIO": ("MEDIANA_SALINIDADE_PLAT", "MEDIANA_ESTRONCIO_PLAT"),
    "SALINIDADE_RELACAO_BA_SR": ("MEDIANA_SALINIDADE_PLAT", "RELACAO_BARIO_ESTRONCIO"),
}


def _extremes(directions: int):
    """Furthest point of a partition in each direction, going round from the left.

    Directions are turned a little, so that rows of points along an axis are no tie.
    """
    angles = np.pi + (np.arange(directions) + 0.381966) * (2 * np.pi / directions)
    rays = np.vstack([np.cos(angles), np.sin(angles)])

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            points = batch[["x", "y"]].to_numpy(float)
            if not len(points):
                continue
            reach = points @ rays
            reach[:, 0] = -points[:, 0]
            # equally far to the left: the lowest
            first = np.lexsort((points[:, 1], points[:, 0]))[0]
            at = reach.argmax(axis=0)
            at[0] = first
            found = np.column_stack([reach[at, np.arange(directions)], points[at]])
            if best is None:
                best = found
            else:
                further = found[:, 0] > best[:, 0]
                further[0] |= found[0, 0] == best[0, 0] and found[0, 2] < best[0, 2]
                best = np.where(further[:, None], found, best)
        if best is not None:
            yield pd.DataFrame({
                "direction": np.arange(directions), "reach": best[:, 0], "x": best[:, 1], "y": best[:, 2]
            })

    return extremes


def _chain(points: np.ndarray) -> np.ndarray:
    """Hull corners, counter-clockwise from the leftmost point (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ordered) -> list:
        kept: list = []
        for p in ordered:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(half(points.tolist()) + half(points[::-1].tolist()))


def _cap(start: np.ndarray, end: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hull corners from ``start`` up to, without, ``end``, given the points outside of that side."""
    corners = _chain(np.vstack([start, end, points]))
    first = int(np.flatnonzero((corners == start).all(axis=1))[0])
    corners = np.roll(corners, -first, axis=0)
    return corners[: int(np.flatnonzero((corners == end).all(axis=1))[0])]


def _outside(core: np.ndarray):
    """Corners of a partition outside of each side of the core, with the number of the side."""
    ends = np.roll(core, -1, axis=0)

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            every = batch[["x", "y"]].to_numpy(float)
            for at in range(0, len(every), 4096):
                points = every[at : at + 4096]
                gap = points[:, None, :] - core[None]
                side = ends - core
                cross = side[:, 0] * gap[:, :, 1] - side[:, 1] * gap[:, :, 0]
                cross /= np.hypot(side[:, 0], side[:, 1])
                nearest = cross.argmin(axis=1)
                out = cross[np.arange(len(points)), nearest] < 0
                for i in np.unique(nearest[out]):
                    new = np.vstack([kept.get(i, points[:0]), points[out & (nearest == i)]])
                    kept[i] = _cap(core[i], ends[i], new)[1:]
        for i, points in kept.items():
            yield pd.DataFrame({"side": np.full(len(points), i), "x": points[:, 0], "y": points[:, 1]})

    return outside


def _caps(core: np.ndarray):
    ends = np.roll(core, -1, axis=0)

    def caps(group: pd.DataFrame) -> pd.DataFrame:
        i = int(group["side"].iloc[0])
        corners = _cap(core[i], ends[i], group[["x", "y"]].to_numpy(float))
        return pd.DataFrame({
            "side": i, "place": np.arange(len(corners)), "x": corners[:, 0], "y": corners[:, 1]
        })

    return caps


def log_points(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.log10(N.col(x)).alias("x"), F.log10(N.col(y)).alias("y"))


def convex_hull(points: DataFrame, directions: int = DIRECTIONS) -> DataFrame:
    """Corners (``pos``, ``x``, ``y``) of the hull of all points, counter-clockwise from the leftmost;
    none if they span no area.

    The furthest points in some directions are corners for certain and form a core. What else is a corner
    lies outside of one side of the core, and each side is worked out by itself. So the corners stay spread
    over as many tasks as there are directions; only the core is seen by the driver.
    """
    spark = points.sparkSession
    furthest = (
        points.mapInPandas(_extremes(directions), f"direction int, reach double, {POINT}")
        .groupBy("direction")
        .agg(F.max(F.struct(
            "reach", F.when(F.col("direction") == 0, -F.col("y")).otherwise(0.0).alias("t"), "x", "y"
        )).alias("p"))
        .orderBy("direction").select("p.x", "p.y").collect()  # one row a direction
    )
    core: list[tuple[float, float]] = []
    for r in furthest:
        if (r["x"], r["y"]) not in core[-1:]:
            core.append((r["x"], r["y"]))
    while len(core) > 1 and core[-1] == core[0]:
        core.pop()
    if len(core) < 2:
        return spark.createDataFrame([], "pos long, x double, y double")
    corners = np.array(core)
    own = spark.createDataFrame([(i, *p) for i, p in enumerate(core)], f"side int, {POINT}")
    found = points.mapInPandas(_outside(corners), f"side int, {POINT}").unionByName(own)
    placed = materialise(found.groupBy("side").applyInPandas(_caps(corners), f"side int, place long, {POINT}"))
    sizes = placed.groupBy("side").agg(F.count(F.lit(1)).alias("n"))  # one row a side
    sides = Window.orderBy("side").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("side", F.coalesce(F.sum("n").over(sides), F.lit(0)).alias("before"))
    total = placed.agg(F.count(F.lit(1))).scalar()
    return placed.join(F.broadcast(before), "side").filter(total > 2).select(
        (F.col("before") + F.col("place")).alias("pos"), "x", "y"
    )


def mark_inside(points: DataFrame, x: Column, y: Column, corners: DataFrame, name: str, strips: int = STRIPS) -> DataFrame:
    """Add ``name``: the point lies in or on the convex counter-clockwise polygon, within a small distance
    of every side; false without a polygon.

    The polygon is cut into upright strips. A strip holds the sides that cross it, so a point is compared with
    the few sides above and below it, however many there are.
    """
    ends = corners.agg(F.struct(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")
    )).scalar()
    low, high = ends["low"], ends["high"]

    def strip(at: Column) -> Column:
        part = F.floor(F.try_divide(at - low, high - low) * strips).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(strips - 1), F.coalesce(part, F.lit(0))))

    following = corners.select(F.col("pos").alias("_next"), F.col("x").alias("bx"), F.col("y").alias("by"))
    sides = corners.withColumn("_next", (F.col("pos") + 1) % ends["n"]).join(following, "_next").select(
        F.explode(F.sequence(strip(F.least("x", "bx")), strip(F.greatest("x", "bx")))).alias("_strip"),
        F.struct(F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by").alias("side"),
    ).groupBy("_strip").agg(F.collect_list("side").alias("_sides"))

    def kept(side: Column) -> Column:
        dx, dy = side["bx"] - side["ax"], side["by"] - side["ay"]
        cross = dx * (F.col("_y") - side["ay"]) - dy * (F.col("_x") - side["ax"])
        beside = (F.col("_x") < F.least(side["ax"], side["bx"]) - TOLERANCE) | (
            F.col("_x") > F.greatest(side["ax"], side["bx"]) + TOLERANCE
        )
        return beside | (cross >= -TOLERANCE * F.sqrt(dx * dx + dy * dy))

    within = (F.col("_x") >= low - TOLERANCE) & (F.col("_x") <= high + TOLERANCE) & (ends["n"] > 2)
    placed = points.withColumns({"_x": x, "_y": y}).withColumns({"_strip": strip(F.col("_x")), "_within": within})
    return (
        placed.join(sides, "_strip", "left")
        .withColumn(name, F.coalesce(F.col("_within") & F.forall("_sides", kept), F.lit(False)))
        .drop("_strip", "_sides", "_x", "_y", "_within")
    )


def similarity_rows(analysis: DataFrame, x: str, y: str) -> DataFrame:
    """Complete rows with both variables above zero."""
    columns = [N.PLATFORM, N.TARGET, "MEDIA_BSW_PLAT", x, y]
    rows = analysis.select(*[N.col(c) for c in columns])
    return complete_cases(rows, columns).filter(all_positive([x, y]))


def mark_similar(analysis: DataFrame, x: str, y: str) -> DataFrame:
    """Clean platforms with ``PERFIL_SEMELHANTE``: inside the hull of the contaminated ones."""
    rows = similarity_rows(analysis, x, y)
    contaminated = materialise(log_points(rows.filter(F.col(N.TARGET) == 1), x, y))
    corners = materialise(convex_hull(contaminated))
    clean = rows.filter(F.col(N.TARGET) == 0)
    return mark_inside(clean, F.log10(N.col(x)), F.log10(N.col(y)), corners, "PERFIL_SEMELHANTE")


def similar_platforms(analysis: DataFrame) -> DataFrame:
    """Similar clean platforms for each pair of variables, tagged with the pair."""
    found = None
    for name, (x, y) in SIMILARITY_PAIRS.items():
        part = mark_similar(analysis, x, y).filter("PERFIL_SEMELHANTE").select(
            F.lit(name).alias("PAR"), N.col(N.PLATFORM), "MEDIA_BSW_PLAT",
            F.col(x).alias("X"), F.col(y).alias("Y"),
        )
        found = part if found is None else found.unionByName(part)
    return found
