"""Registered queries: one per operator, with the SQL that must give the same rows.

Doubles are rounded and dates written as text on both sides. Before rounding, both
sides add the same small shift: means and medians of decimals often end exactly halfway
between two rounded values, where the last bit of a sum would decide.
Every query of this package has its SQL, the fitted models (Newton steps) and hulls included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def _shift(digits: int) -> float:
    return float(f"3.1e-{digits + 2}")


def r(value: Column | str, digits: int = 6) -> Column:
    value = col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(_shift(digits)), digits)


def day(value: Column | str) -> Column:
    return F.date_format(col(value) if isinstance(value, str) else value, "yyyy-MM-dd")


def number(value: Column | str) -> Column:
    return (col(value) if isinstance(value, str) else value).cast("double")


def shown(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Select under plain names."""
    return df.select(*[
        (col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()
    ])


def R(value: str, digits: int = 6) -> str:
    """SQL of a rounded double, without negative zero."""
    return f"(round({value} + {_shift(digits)!r}::DOUBLE, {digits}) + 0.0)"


def D(value: str) -> str:
    """SQL of a date as text."""
    return f"strftime({value}, '%Y-%m-%d')"
