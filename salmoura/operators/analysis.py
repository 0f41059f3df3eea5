"""Platform-month series cut to the class period and summed up per platform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura import names as N
from salmoura.functions.columns import months_between, ratio
from salmoura.operators.waste import platform_summary

WINDOW = "janela"
NEAREST = "data"
PERIOD_COLUMNS = ["DATA_MIN", "DATA_MAX"]


def with_period(months: DataFrame, periods: DataFrame) -> DataFrame:
    """Platform-months of the platforms that have a class period, with that period and
    whatever else ``periods`` tells of the platform."""
    return months.join(periods, N.PLATFORM)


def within_period(dated: DataFrame) -> DataFrame:
    return dated.filter(F.col(N.MONTH).between(F.col("DATA_MIN"), F.col("DATA_MAX")))


def nearest_month(dated: DataFrame) -> DataFrame:
    """All rows of the one month per platform that lies nearest to ``DATA_MIN``; the earlier
    month wins a tie."""
    gap = months_between(F.col(N.MONTH), F.col("DATA_MIN"))
    closest = Window.partitionBy(N.col(N.PLATFORM)).orderBy(
        F.abs(gap).asc_nulls_last(), gap.asc_nulls_last(), F.col(N.MONTH).asc_nulls_last()
    )
    return (
        dated.withColumns({"DIFERENCA_MESES": gap, "DISTANCIA_MESES": F.abs(gap)})
        .withColumn("_rank", F.rank().over(closest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def _check_mode(mode: str) -> None:
    if mode not in (WINDOW, NEAREST):
        raise ValueError(f"mode must be '{NEAREST}' or '{WINDOW}'")


def _platform_name(months: DataFrame) -> DataFrame:
    """Accept the platform under its other names."""
    if N.PLATFORM in months.columns:
        return months
    return months.withColumnsRenamed({N.SITE: N.PLATFORM, N.CODE: N.PLATFORM})


def cut_to_period(months: DataFrame, summary: DataFrame, mode: str = NEAREST) -> DataFrame:
    """Platform-months of the class period (``janela``) or nearest to its start (``data``)."""
    _check_mode(mode)
    classed = summary.filter((F.col(N.TARGET) == 1) | (F.col("TEM_OLEOSA") == 1))
    dated = with_period(_platform_name(months), classed)
    return within_period(dated) if mode == WINDOW else nearest_month(dated)


def repeated_months(months: DataFrame) -> DataFrame:
    """Platform-months that occur more than once, with their ``count``."""
    return months.groupBy(N.col(N.PLATFORM), N.MONTH).count().filter("count > 1")


def require_unique_months(months: DataFrame) -> DataFrame:
    """Raise now, with up to five examples, if a platform-month occurs more than once."""
    repeated = repeated_months(months).limit(5).collect()
    if repeated:
        examples = [(r[N.PLATFORM], str(r[N.MONTH])) for r in repeated]
        raise ValueError(f"one row per platform and month expected, repeated: {examples}")
    return months


def _once(n: Column) -> Column:
    """True for a key seen once, else the query fails; costs no extra pass."""
    message = F.concat_ws(
        " ", F.lit("one row per platform and month expected, repeated:"),
        N.col(N.PLATFORM), F.col(N.MONTH).cast("string"),
    )
    return F.when(n == 1, True).otherwise(F.raise_error(message).cast("boolean"))


def monthly_by_platform(months: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Monthly volumes and chemistry per platform, with the water cut of the volumes.

    Missing volumes count as zero. A repeated platform-month makes the query fail.
    ``carry`` names columns that depend on the platform alone and are kept.
    """
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0))

    keyed = months.dropna(subset=[N.PLATFORM, N.MONTH])
    monthly = keyed.groupBy(N.col(N.PLATFORM), N.MONTH, *carry).agg(
        F.count(F.lit(1)).alias("_rows"),
        total(N.WATER_MONTH).alias("AGUA_PLAT"),
        total(N.OIL_MONTH).alias("OLEO_PLAT"),
        *[F.max(c).alias(f"{c}_PLAT") for c in ("BARIO", "ESTRONCIO", "SALINIDADE")],
    )
    volume = F.col("AGUA_PLAT") + F.col("OLEO_PLAT")
    return (
        monthly.filter(_once(F.col("_rows")))
        .drop("_rows")
        .withColumn("BSW_PLAT", F.when(volume > 0, F.col("AGUA_PLAT") / volume * 100))
    )


def platform_statistics(monthly: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Seventeen statistics per platform over its months; ``carry`` as above."""
    def spread(name: str) -> list[Column]:
        c = F.col(f"{name}_PLAT")
        return [
            F.median(c).alias(f"MEDIANA_{name}_PLAT"),
            F.avg(c).alias(f"MEDIA_{name}_PLAT"),
            F.stddev_samp(c).alias(f"STD_{name}_PLAT"),
        ]

    water, bsw = F.col("AGUA_PLAT"), F.col("BSW_PLAT")
    return monthly.groupBy(N.col(N.PLATFORM), *carry).agg(
        F.median(water).alias("MEDIANA_AGUA_PLAT"),
        F.avg(water).alias("MEDIA_AGUA_PLAT"),
        F.coalesce(F.sum(water), F.lit(0.0)).alias("SOMA_AGUA_PLAT"),
        F.avg(bsw).alias("MEDIA_BSW_PLAT"),
        F.median(bsw).alias("MEDIANA_BSW_PLAT"),
        F.percentile(bsw, 0.25).alias("P25_BSW_PLAT"),
        F.percentile(bsw, 0.75).alias("P75_BSW_PLAT"),
        F.stddev_samp(bsw).alias("STD_BSW_PLAT"),
        *spread("BARIO"),
        *spread("ESTRONCIO"),
        *spread("SALINIDADE"),
    )


def join_statistics(platforms: DataFrame, statistics: DataFrame) -> DataFrame:
    """Platforms with a known mean water cut, their statistics and the ratio of medians."""
    return with_ratio(platforms.join(statistics, N.PLATFORM, "left"))


def with_ratio(statistics: DataFrame) -> DataFrame:
    known = statistics.filter(F.col("MEDIA_BSW_PLAT").isNotNull())
    return known.withColumn(
        "RELACAO_BARIO_ESTRONCIO",
        ratio(F.col("MEDIANA_BARIO_PLAT"), F.col("MEDIANA_ESTRONCIO_PLAT")),
    )


def analysis_table(waste: DataFrame, months: DataFrame, mode: str = NEAREST) -> DataFrame:
    """One row per platform: class, masses, statistics of its water, Ba/Sr ratio.

    The summary of each platform travels with its months as extra grouping keys, so
    the waste is aggregated once and joined once. From the join on, everything is
    keyed by platform and keeps that partitioning.
    """
    summary = platform_summary(waste)
    carry = [c for c in summary.columns if c not in (N.PLATFORM, *PERIOD_COLUMNS)]
    monthly = monthly_by_platform(cut_to_period(months, summary, mode), carry)
    return with_ratio(platform_statistics(monthly, carry))
