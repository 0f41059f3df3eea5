"""Column expressions shared by all operators. Everything here stays inside codegen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from salmoura.names import col

INFINITY = float("inf")


def finite(c: Column) -> Column:
    """NaN and both infinities become null (NaN compares above infinity)."""
    return F.when(F.abs(c) < F.lit(INFINITY), c)


def as_double(c: Column, text: bool = True) -> Column:
    """Double, NaN and infinities among them, or null. Java literals such as ``1d`` or ``2F`` are no numbers here; a text that
    ends in a digit is none of them."""
    value = c.try_cast("double")
    if text:
        value = F.when(F.substring(c, -1, 1).isin(*"0123456789") | ~c.rlike(r"[dDfF]\s*$"), value)
    return value


def to_number(c: Column, text: bool = True) -> Column:
    """Finite double or null."""
    return finite(as_double(c, text))


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def complete(names: Iterable[str]) -> Column:
    """True where none of the columns is missing."""
    return _all(col(n).isNotNull() for n in names)


def all_positive(names: Iterable[str]) -> Column:
    return _all(col(n) > 0 for n in names)


def is_contaminated(waste_type: Column) -> Column:
    """Waste logged as oily sludge with naturally occurring radioactive material."""
    return F.coalesce(F.upper(waste_type).contains("BORRA OLEOSA COM NORM"), F.lit(False))


def is_oily(waste_type: Column) -> Column:
    """Oily sludge whose text has no ``NORM`` anywhere, be it part of another word."""
    text = F.upper(waste_type)
    return F.coalesce(text.contains("BORRA OLEOSA") & ~text.contains("NORM"), F.lit(False))


def value_where(condition: Column, value: Column, otherwise: float = 0.0) -> Column:
    return F.when(condition, value).otherwise(F.lit(otherwise))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is positive, else null."""
    return finite(F.when(denominator > 0, numerator / denominator))


def month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def months_between(later: Column, earlier: Column) -> Column:
    """Signed whole-month difference of the calendar months."""
    return month_number(later) - month_number(earlier)


def same_month_flag(month: Column, first: Column) -> Column:
    return F.coalesce(month == first, F.lit(False)).cast("int")


def class_label(flag: Column) -> Column:
    return F.when(flag == 1, "Com NORM").when(flag == 0, "Sem NORM")


def outcome_label(actual: Column, predicted: Column) -> Column:
    return (
        F.when((actual == 1) & (predicted == 1), "Verdadeiro positivo")
        .when((actual == 0) & (predicted == 0), "Verdadeiro negativo")
        .when((actual == 0) & (predicted == 1), "Falso positivo")
        .when((actual == 1) & (predicted == 0), "Falso negativo")
        .otherwise("Não classificado")
    )


def marker_size(mass: Column, largest_log: Column) -> Column:
    """Marker diameter growing with log(1 + mass); masses below zero count as zero."""
    return 6 + 22 * F.log1p(F.greatest(mass, F.lit(0.0))) / F.greatest(largest_log, F.lit(1.0))


def bubble_size(bsw: Column) -> Column:
    return 35 + F.sqrt(F.greatest(bsw, F.lit(0.0))) * 35


def mean_sd_text(mean: Column, sd: Column, decimals: int = 3) -> Column:
    return F.format_string(f"%.{decimals}f ± %.{decimals}f", mean, sd)


def percent_text(mean: Column, sd: Column) -> Column:
    """``92% ± 4%``"""
    return F.format_string("%.0f%% ± %.0f%%", mean * 100, sd * 100)
