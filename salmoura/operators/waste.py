"""Waste records: append of two logs, platform classes and class periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from salmoura import names as N
from salmoura.functions.columns import is_contaminated, is_oily, to_number, value_where
from salmoura.operators.cleaning import sort_rows

WITH_NORM = "Borra oleosa com NORM"
WITHOUT_NORM = "Borra oleosa sem NORM"


def append_newer(
    history: DataFrame, newer: DataFrame, column: str = N.MONTH, ordered: bool = True
) -> DataFrame:
    """``history`` plus the rows of ``newer`` dated strictly after its last date.

    The last date is a scalar subquery, so nothing is joined or collected.
    """
    last = history.agg(F.max(N.col(column)).alias("last")).scalar()
    both = history.unionByName(newer.filter(N.col(column) > last), allowMissingColumns=True)
    return sort_rows(both, [column]) if ordered else both


def sum_by(
    waste: DataFrame,
    keys: Sequence[str] = (N.PLATFORM, N.WASTE_TYPE),
    values: Sequence[str] = (N.MASS,),
) -> DataFrame:
    """Totals per key; a group without any value has total 0, rows without a key are left out."""
    known = waste.dropna(subset=list(keys))
    return known.groupBy(*[N.col(k) for k in keys]).agg(
        *[F.coalesce(F.sum(N.col(v)), F.lit(0.0)).alias(v) for v in values]
    )


def _mass(waste: DataFrame) -> Column:
    return to_number(N.col(N.MASS), dict(waste.dtypes)[N.MASS] == "string")


def _classified(waste: DataFrame) -> DataFrame:
    kind = N.col(N.WASTE_TYPE)
    return waste.filter(N.col(N.PLATFORM).isNotNull()).select(
        N.col(N.PLATFORM),
        N.col(N.MONTH),
        _mass(waste).alias("_mass"),
        is_contaminated(kind).alias("_norm"),
        is_oily(kind).alias("_oily"),
    )


def _flag_aggregates() -> list[Column]:
    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return [
        F.max(F.col("_norm").cast("int")).alias(N.TARGET),
        F.max(F.col("_oily").cast("int")).alias("_any_oily"),
        total(F.col("_mass")).alias("MASSA_TOTAL"),
        total(value_where(F.col("_norm"), F.col("_mass"))).alias("MASSA_NORM_KG"),
        total(value_where(F.col("_oily"), F.col("_mass"))).alias("MASSA_OLEOSA_KG"),
    ]


def _with_class(grouped: DataFrame, *extra: Column) -> DataFrame:
    contaminated = F.col(N.TARGET) == 1
    return grouped.select(
        N.col(N.PLATFORM),
        N.TARGET,
        F.when(contaminated, 0).otherwise(F.col("_any_oily")).alias("TEM_OLEOSA"),
        "MASSA_TOTAL",
        "MASSA_NORM_KG",
        "MASSA_OLEOSA_KG",
        F.when(contaminated, F.col("MASSA_NORM_KG"))
        .otherwise(F.col("MASSA_OLEOSA_KG"))
        .alias("MASSA_CLASSIFICADA_KG"),
        F.when(contaminated, WITH_NORM).otherwise(WITHOUT_NORM).alias("TIPO_MASSA"),
        *extra,
    )


def platform_flags(waste: DataFrame) -> DataFrame:
    """One row per platform: class flags (contaminated overrides oily) and masses per class."""
    return _with_class(
        _classified(waste).groupBy(N.col(N.PLATFORM)).agg(*_flag_aggregates())
    )


def flagged_waste(waste: DataFrame, flags: DataFrame) -> DataFrame:
    """Waste rows with the flags of their platform."""
    return waste.join(flags.select(N.col(N.PLATFORM), N.TARGET, "TEM_OLEOSA"), N.PLATFORM)


def of_own_class(kind: Column) -> Column:
    """Row shows the very waste that gave its platform its class."""
    return ((F.col(N.TARGET) == 1) & is_contaminated(kind)) | (
        (F.col("TEM_OLEOSA") == 1) & is_oily(kind)
    )


def class_period(flagged: DataFrame) -> DataFrame:
    """First and last month per platform over the rows of its own class."""
    own = flagged.filter(of_own_class(N.col(N.WASTE_TYPE)))
    return own.groupBy(N.col(N.PLATFORM)).agg(
        F.min(N.col(N.MONTH)).alias("DATA_MIN"), F.max(N.col(N.MONTH)).alias("DATA_MAX")
    )


def platform_summary(waste: DataFrame) -> DataFrame:
    """Flags, masses and class period of every platform from a single aggregation.

    Same values as :func:`platform_flags` and :func:`class_period` together, but the
    waste rows are read and shuffled once (and combined before the shuffle) and
    never joined back. Platforms of neither class have no period.
    """
    month = N.col(N.MONTH)
    ends = {
        f"_{name}_{kind}": how(F.when(F.col(f"_{kind}"), month))
        for name, how in (("min", F.min), ("max", F.max))
        for kind in ("norm", "oily")
    }
    grouped = _classified(waste).groupBy(N.col(N.PLATFORM)).agg(
        *_flag_aggregates(), *[e.alias(name) for name, e in ends.items()]
    )
    contaminated = F.col(N.TARGET) == 1
    return _with_class(
        grouped,
        F.when(contaminated, F.col("_min_norm")).otherwise(F.col("_min_oily")).alias("DATA_MIN"),
        F.when(contaminated, F.col("_max_norm")).otherwise(F.col("_max_oily")).alias("DATA_MAX"),
    )
