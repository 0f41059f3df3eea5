"""Temporal validation table: what was known of a platform month by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salmoura import names as N
from salmoura.functions.columns import (
    complete,
    is_contaminated,
    is_oily,
    months_between,
    ratio,
    same_month_flag,
)
from salmoura.operators.cleaning import sort_rows

SERIES_COLUMNS = [
    N.PLATFORM, N.MONTH, "SALINIDADE", "BARIO", "ESTRONCIO",
    N.WATER_MONTH, N.OIL_MONTH, N.BSW, N.N_WELLS,
]
CONTEXT_COLUMNS = [
    N.PLATFORM, N.MONTH, "TEM_NORM", "TEM_NORM_MES", "PRIMEIRO_NORM",
    "DATA_PRIMEIRO_NORM", "MESES_ATE_NORM", "ELEGIVEL_MODELO",
]


def _classed_months(waste: DataFrame) -> DataFrame:
    """As :func:`monthly_class`, with one row more for the undated records of a platform."""
    kind = N.col(N.WASTE_TYPE)
    oily = F.coalesce(F.upper(kind).contains("BORRA OLEOSA"), F.lit(False))  # either class; asked first, as most rows fail it
    classed = waste.filter(oily & (is_contaminated(kind) | is_oily(kind))).dropna(subset=[N.PLATFORM])
    return classed.groupBy(N.col(N.PLATFORM), N.MONTH).agg(
        F.max(is_contaminated(kind).cast("int")).alias("TEM_NORM_MES")
    )


def monthly_class(waste: DataFrame) -> DataFrame:
    """1 per platform-month with contaminated sludge, 0 with only oily sludge, no row otherwise."""
    return _classed_months(waste).dropna(subset=[N.MONTH])


def platform_class(waste: DataFrame) -> DataFrame:
    """Class and first contaminated month of every platform with classed waste."""
    return _classed_months(waste).groupBy(N.col(N.PLATFORM)).agg(
        F.max("TEM_NORM_MES").alias("TEM_NORM"),
        F.min(F.when(F.col("TEM_NORM_MES") == 1, F.col(N.MONTH))).alias("DATA_PRIMEIRO_NORM"),
    )


def first_occurrence(monthly: DataFrame) -> DataFrame:
    """First month with contaminated sludge per platform."""
    return monthly.filter("TEM_NORM_MES = 1").groupBy(N.col(N.PLATFORM)).agg(
        F.min(N.MONTH).alias("DATA_PRIMEIRO_NORM")
    )


def temporal_table(months: DataFrame, waste: DataFrame, ordered: bool = True) -> DataFrame:
    """Platform-months with the class of the month, of the platform, and the way to its first
    contaminated month. Months without a classed record keep a missing class.

    The join by platform comes first: the series is partitioned by platform already. Both
    class tables stand on the same aggregate of the waste, which is made and shuffled once: the join by month
    takes equal missing months for equal, since Spark would otherwise drop them below one of the two aggregates.
    """
    series = months.select(*[N.col(c) for c in SERIES_COLUMNS if c in months.columns])
    month, first = F.col(N.MONTH), F.col("DATA_PRIMEIRO_NORM")
    classes = _classed_months(waste).select(
        N.col(N.PLATFORM).alias("_platform"), month.alias("_month"), F.col("TEM_NORM_MES").alias("_class"))
    table = (
        series.withColumn(N.RATIO, ratio(F.col("BARIO"), F.col("ESTRONCIO")))
        .join(platform_class(waste), N.PLATFORM, "left")
        .join(classes, (N.col(N.PLATFORM) == F.col("_platform")) & month.eqNullSafe(F.col("_month")), "left")
        .withColumn("TEM_NORM_MES", F.when(month.isNotNull(), F.col("_class")))
        .drop("_platform", "_month", "_class")
        .withColumns({
            "PRIMEIRO_NORM": same_month_flag(month, first),
            "MESES_ATE_NORM": months_between(first, month),
            "ELEGIVEL_MODELO": complete(N.FEATURES),
        })
    )
    return sort_rows(table, [N.PLATFORM, N.MONTH]) if ordered else table


def scoring_input(table: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows the model can take: context columns that are present, then the features."""
    wanted = [c for c in CONTEXT_COLUMNS if c in table.columns] + N.FEATURES
    rows = (
        table.filter("ELEGIVEL_MODELO")
        .select(*[N.col(c) for c in wanted])
        .withColumnRenamed(N.PLATFORM, N.SITE)
    )
    return sort_rows(rows, [N.SITE, N.MONTH]) if ordered else rows
