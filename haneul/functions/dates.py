"""Months, days and periods, as columns. Months are text `yyyy-MM`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(ts: Column, hours: int = 9) -> Column:
    """The day at UTC+hours, as text; folded once, where rows are made."""
    return F.date_format(ts + F.expr(f"interval {hours} hours"), "yyyy-MM-dd")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def index_month(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))


def shift_month(month: Column, by: int) -> Column:
    return index_month(month_index(month) + by)


def is_month(c: Column) -> Column:
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def months_between(first: Column, last: Column) -> Column:
    """Array of every month from first to last."""
    return F.transform(F.sequence(month_index(first), month_index(last)), index_month)


def publication_date(text: Column) -> Column:
    """struct(date, precision): a day as it is, a month at its end, a year at December 31; else null."""
    day, month, year = text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.rlike(r"^\d{4}-\d{2}$"), text.rlike(r"^\d{4}$")
    date = F.when(day, F.try_to_date(text)).when(month, F.last_day(F.try_to_date(F.concat(text, F.lit("-01"))))).when(year, F.try_to_date(F.concat(text, F.lit("-12-31"))))
    return F.struct(date.alias("date"), F.when(date.isNull(), None).when(day, "day").when(month, "month").otherwise("year").alias("precision"))


def part_of_month(day: Column) -> Column:
    return F.when(day <= 10, "초").when(day <= 20, "중순").otherwise("말")


def parse_period(text: Column, today: str) -> Column:
    """struct(from, to) of months that a question names; rules by precedence: year-month, recent N
    months, relative year (and month), relative month, year, bare month (a future one is last year's)."""
    now = F.lit(today[:7])
    year = F.lit(int(today[:4]))
    at = lambda pattern, group=1: F.regexp_extract(text, pattern, group)
    number = lambda pattern, group=1: F.nullif(at(pattern, group), F.lit("")).cast("int")
    span = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    month = lambda y, m: F.format_string("%04d-%02d", y, m)
    ym = r"(\d{4})\s*[-년.]\s*(\d{1,2})"
    rel_year = F.when(text.contains("재작년"), year - 2).when(text.contains("작년"), year - 1).when(text.contains("올해"), year)
    bare = number(r"(?:^|[^\d])(\d{1,2})월")
    valid = lambda m: (m >= 1) & (m <= 12)
    recent = number(r"최근\s*(\d{1,3})\s*개월")
    bare_year = number(r"(\d{4})\s*년")
    this = F.lit(int(today[5:7]))
    return (
        F.when(number(ym).isNotNull() & valid(number(ym, 2)), span(month(number(ym), number(ym, 2)), month(number(ym), number(ym, 2))))
        .when(recent.isNotNull() & (recent > 0), span(index_month(month_index(now) - recent + 1), now))
        .when(rel_year.isNotNull() & valid(bare), span(month(rel_year, bare), month(rel_year, bare)))
        .when(rel_year.isNotNull(), span(month(rel_year, F.lit(1)), month(rel_year, F.lit(12))))
        .when(text.contains("지난달"), span(index_month(month_index(now) - 1), index_month(month_index(now) - 1)))
        .when(text.contains("이번달"), span(now, now))
        .when(bare_year.isNotNull(), span(month(bare_year, F.lit(1)), month(bare_year, F.lit(12))))
        .when(valid(bare), span(month(year - (bare > this).cast("int"), bare), month(year - (bare > this).cast("int"), bare)))
    )
