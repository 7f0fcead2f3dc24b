"""Rounding and formatting of figures, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Half toward positive infinity (-2.5 -> -2), where round() goes away from zero."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def round_decimal(c: Column, digits: int) -> Column:
    """Half away from zero on the decimal value, so that binary noise doesn't decide a tie."""
    return F.round(c.cast("decimal(18,6)"), digits).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(0).cast("long")


def share_1(part: Column, whole: Column) -> Column:
    """Percent with one decimal, 0 where the whole is 0."""
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10).otherwise(F.lit(0.0))


def change_percent(now: Column, before: Column) -> Column:
    """Whole percent of change; null (not 0) without a previous figure or on a previous 0."""
    return F.when(before.isNotNull() & (before != 0), F.floor((now - before) * 100.0 / before + 0.5)).cast("long")


def direction(delta: Column) -> Column:
    return F.when(delta.isNull(), None).when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")


def mantissa(c: Column) -> Column:
    """The figure without its power of ten, to 6 significant digits: 2,340 and 2.34 are the same figure in other units."""
    a = F.abs(c)
    return F.when(a == 0, F.lit(0.0)).otherwise(F.round(a / F.pow(F.lit(10.0), F.floor(F.log10(a))), 5))


def parse_number(c: Column) -> Column:
    """'1,234.5' -> 1234.5; anything that isn't wholly a number is null."""
    bare = F.regexp_replace(F.trim(c), ",", "")
    return F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare.cast("double"))


def format_unit(value: Column, unit: Column) -> Column:
    """Thousand persons are shown as ten thousands, points with one decimal, ratios with two, money whole."""
    return (
        F.when(value.isNull(), None)
        .when(unit == "%p", F.concat(F.format_number(value, 1), F.lit("%p")))
        .when(unit == "억원", F.concat(F.format_number(value, 0), F.lit("억원")))
        .when(unit == "배", F.concat(F.format_number(value, 2), F.lit("배")))
        .otherwise(F.concat(F.format_number(value / 10, 1), F.lit("만명")))
    )
