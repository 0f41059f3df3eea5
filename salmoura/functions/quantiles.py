"""Exact percentiles per group.

Rows are sent once, to the task of their group, where each variable's values are put in order and the wanted ranks are read
off. Groups of more than ``LARGE`` rows are known before that, from counts, and are left out: they are never sent to
one task. Their percentiles are selected by histogram:

1. Values are counted per band, before and after the shuffle. A band keeps the order of values and holds those that agree
   in sign and in their logarithm to about one thousandth, so a group has as many counts as bands, whatever its rows.
2. The counts of a group are summed in order; that tells the bands of the wanted ranks, two a percentile at most.
3. Only the values of those bands are sent on, counted per distinct value, and the wanted ranks are read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura.names import col
from salmoura.session import materialise

BANDS = 1024      # per factor e of the values
LARGE = 100_000   # rows of a group that one task still puts in order
SLOTS = 1 << 16   # parts of the keys' hashes whose rows are counted first


def _between(position: Column, a: Column, b: Column) -> Column:
    """Linear interpolation between the values below and above a fractional rank."""
    return F.when(a == b, a).otherwise(
        (F.ceil(position) - position) * a + (position - F.floor(position)) * b
    )


def band(value: Column) -> Column:
    """Number of the band of a double: never smaller for a larger value."""
    size = F.floor(F.ln(F.abs(value)) * BANDS).cast("int") + 1_000_000  # logarithms begin at -745
    edge = F.lit(2_000_000)
    return (
        F.when(F.isnan(value), edge + 1)
        .when(F.abs(value) == float("inf"), F.when(value > 0, edge).otherwise(-edge))
        .when(value == 0, 0)
        .when(value > 0, size)
        .otherwise(-size)
    )


def _number(column: str) -> Column:
    """As a double; adding zero makes one value of both zeros."""
    return col(column).cast("double") + 0.0


def _in_order(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], percentiles: dict[str, tuple[str, float]]
) -> DataFrame:
    """Groups of bounded size: one shuffle of the rows, then sorted arrays."""
    by = [col(k) for k in keys]
    variables = {c: f"_sorted{i}" for i, c in enumerate(sorted({c for c, _ in percentiles.values()}))}
    # sent as rows: what aggregates of unequal values would send is larger
    sent = df.repartition(*by)
    sets = sent.groupBy(*by).agg(
        *aggregates, *[F.sort_array(F.collect_list(_number(c))).alias(out) for c, out in variables.items()]
    )

    def exact(out: str, variable: str, p: float) -> Column:
        values = F.col(variables[variable])
        position = (F.size(values) - 1) * F.lit(float(p))
        a, b = (F.element_at(values, (rank + 1).cast("int")) for rank in (F.floor(position), F.ceil(position)))
        return F.when(F.size(values) > 0, _between(position, a, b)).alias(out)

    picked = [exact(out, c, p) for out, (c, p) in percentiles.items()]
    others = [col(c) for c in sets.columns if c not in keys and c not in variables.values()]
    return sets.select(*by, *others, *picked)


def _by_histogram(df: DataFrame, keys: Sequence[str], percentiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of groups of any size; what is shuffled does not grow with a group but for the bands picked."""
    by = [col(k) for k in keys]
    variables = {c: i for i, c in enumerate(sorted({c for c, _ in percentiles.values()}))}
    values = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_var"), _number(c).alias("_value")) for c, i in variables.items()
    ]))).filter(F.col("_value").isNotNull()).withColumn("_band", band(F.col("_value")))
    whole = Window.partitionBy(*by, "_var")
    earlier = whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = values.groupBy(*by, "_var", "_band").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(whole),
    })

    def ranks(variable: str, p: float) -> tuple[Column, Column, Column]:
        position = (F.col("_all") - 1) * F.lit(float(p))
        return position, F.floor(position), F.ceil(position)

    def here(variable: str, rank: Column, until: Column) -> Column:
        return (F.col("_var") == variables[variable]) & (F.col("_before") <= rank) & (rank < until)

    wanted = F.lit(False)
    for c, p in percentiles.values():
        for rank in ranks(c, p)[1:]:
            wanted = wanted | here(c, rank, F.col("_before") + F.col("_n"))
    chosen = bands.filter(wanted).select(*by, "_var", "_band", F.col("_before").alias("_below"), "_all")
    inside = Window.partitionBy(*by, "_var", "_band").orderBy("_value")
    ranked = values.join(chosen, [*keys, "_var", "_band"]).groupBy(*by, "_var", "_band", "_below", "_all", "_value").agg(
        F.count(F.lit(1)).alias("_n")
    ).withColumn("_upto", F.col("_below") + F.sum("_n").over(inside)).withColumn("_before", F.col("_upto") - F.col("_n"))

    def exact(out: str, variable: str, p: float) -> Column:
        position, low, high = ranks(variable, p)
        own = F.max(F.when(F.col("_var") == variables[variable], position))
        a, b = (F.max(F.when(here(variable, rank, F.col("_upto")), F.col("_value"))) for rank in (low, high))
        return _between(own, a, b).alias(out)

    return ranked.groupBy(*by).agg(*[exact(out, c, p) for out, (c, p) in percentiles.items()])


def grouped(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    percentiles: dict[str, tuple[str, float]],
    large: int = LARGE,
) -> DataFrame:
    """Aggregate ``df`` by ``keys`` (without missing ones) with ordinary aggregates and exact percentiles.

    ``percentiles`` maps an output name to (column, fraction); missing values are
    skipped and the result interpolates linearly. The keys of ``df`` are read once more, to count them.
    """
    by = [col(k) for k in keys]
    # rows per slot of the keys' hash, a row a slot and task: where no slot is large, no group is
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS)).cast("int")
    full = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large)
    slots = [r["_slot"] for r in full.select("_slot").collect()]  # at most all slots
    if not slots:
        return _in_order(df, keys, aggregates, percentiles)
    # at most rows / large groups
    some = df if len(slots) > 1024 else df.filter(slot.isin(slots))
    many = some.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).select(*by)
    if many.isEmpty():
        return _in_order(df, keys, aggregates, percentiles)
    many = materialise(many)
    heavy = materialise(df.join(many, list(keys), "left_semi"))
    picked = _by_histogram(heavy, keys, percentiles)
    others = heavy.groupBy(*by).agg(*aggregates) if aggregates else many
    light = _in_order(df.join(many, list(keys), "left_anti"), keys, aggregates, percentiles)
    return light.unionByName(others.join(picked, list(keys), "left"))


def whole_table(df: DataFrame, percentiles: dict[str, tuple[str, float]], large: int = LARGE) -> DataFrame:
    """Exact percentiles over all rows, as one row."""
    return grouped(df.withColumn("_all_rows", F.lit(1)), ["_all_rows"], [], percentiles, large).drop("_all_rows")
