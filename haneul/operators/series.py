"""Monthly series: observations (source, series, breakdown, category, period, value[, yoy])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import index_month, month_index, shift_month
from ..functions.numbers import round_half_up

KEY = ("source", "series", "breakdown", "category")


def observations(df: DataFrame, source: str, breakdown: str, series: str | None = None, category: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Source and breakdown are required; the rest narrow further; months are inclusive. Filters reach the scan."""
    df = df.where((F.col("source") == source) & (F.col("breakdown") == breakdown))
    for column, value in (("series", series), ("category", category)):
        df = df if value is None else df.where(F.col(column) == value)
    df = df if start is None else df.where(F.col("period") >= start)
    df = df if end is None else df.where(F.col("period") <= end)
    return df.orderBy("period")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's newest period, found under the same predicates as the rows."""
    newest = df.groupBy(*keys).agg(F.max("period").alias("period"))
    return df.join(newest, [*keys, "period"], "left_semi")


def year_over_year(df: DataFrame, keys: list[str]) -> DataFrame:
    """value minus that of the same month a year before; null where that month is missing (so never a lag of 12 rows)."""
    before = df.select(*keys, shift_month(F.col("period"), 12).alias("period"), F.col("value").alias("before"))
    return df.join(before, [*keys, "period"], "left").withColumn("yoy", F.col("value") - F.col("before")).drop("before")


def contiguous_tail(df: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of consecutive months that ends at a key's newest one."""
    newest_first = W.partitionBy(*keys).orderBy(F.desc("period"))
    island = month_index(F.col("period")) + F.row_number().over(newest_first)
    marked = df.withColumn("_i", island)
    return marked.withColumn("_last", F.max("_i").over(W.partitionBy(*keys))).where("_i = _last").drop("_i", "_last")


def last_points(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    newest = W.partitionBy(*keys).orderBy(F.desc("period"))
    return df.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")


def fill_months(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every month between a key's first and last; value null (not 0) where missing."""
    spans = df.groupBy(*keys).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    months = spans.select(*keys, F.explode(F.transform(F.sequence(month_index(F.col("a")), month_index(F.col("b"))), index_month)).alias("period"))
    return months.join(df, [*keys, "period"], "left")


def month_options(df: DataFrame, n_sources: int) -> DataFrame:
    """Months to choose from: from the first month in which all sources have a total, to the newest; gaps filled."""
    totals = df.where("breakdown = 'total'")
    floor = totals.groupBy("period").agg(F.count_distinct("source").alias("n")).where(F.col("n") == n_sources).agg(F.min("period").alias("a"))
    newest = totals.agg(F.max("period").alias("b"))
    both = floor.crossJoin(newest).where("a is not null")  # one row each
    return both.select(F.explode(F.transform(F.sequence(month_index(F.col("a")), month_index(F.col("b"))), index_month)).alias("period"))


def matrix(categories: DataFrame, df: DataFrame, sources: list[str], period: str) -> DataFrame:
    """Categories by sources at a month, a state for each cell: notProvided (the source doesn't have the
    category), unpublished (no value), noDelta (no year-over-year), value."""
    cells = categories.withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    found = df.where(F.col("period") == period).select("source", "breakdown", "category", "value", "yoy")
    joined = cells.join(found, ["source", "breakdown", "category"], "left")
    state = F.when(~F.coalesce(F.try_element_at("provided", F.col("source")), F.lit(False)), "notProvided").when(F.col("value").isNull(), "unpublished").when(F.col("yoy").isNull(), "noDelta").otherwise("value")
    return joined.select("breakdown", "category", "source", state.alias("state"), "value", "yoy")


def matrix_wide(cells: DataFrame, sources: list[str]) -> DataFrame:
    """One row per category, sorted by its largest absolute change, those without any last."""
    wide = cells.groupBy("breakdown", "category").pivot("source", sources).agg(F.first("yoy"))
    size = F.greatest(*[F.coalesce(F.abs(F.col(f"`{s}`")), F.lit(-1)) for s in sources])
    return wide.withColumn("max_abs", size).orderBy(F.desc("max_abs"), "category")


def top_movers(df: DataFrame, n: int = 3) -> DataFrame:
    """Per breakdown, the n categories that changed most, up or down; no change known is no move."""
    order = W.partitionBy("breakdown").orderBy(F.desc(F.abs("yoy")), "source", "category")
    return df.where("yoy is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def derive(df: DataFrame, keys: list[str]) -> DataFrame:
    """Figures that the shape of the observations allows: one period, many rows: total and largest share;
    many periods, one row each: difference and rate; anything else: neither."""
    shape = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("period").alias("periods"), F.sum("value").alias("total"), F.max("value").alias("most"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"))
    cross, time = (F.col("periods") == 1) & (F.col("n") > 1), (F.col("periods") > 1) & (F.col("periods") == F.col("n"))
    return shape.select(
        *keys, F.when(cross, "cross-section").when(time, "time-series").otherwise("mixed").alias("shape"),
        F.when(cross, F.col("total")).alias("sum"), F.when(cross & (F.col("total") != 0), round_half_up(F.col("most") * 100.0 / F.col("total"), 1)).alias("top_share"),
        F.when(time, F.col("last") - F.col("first")).alias("diff"), F.when(time & (F.col("first") != 0), round_half_up((F.col("last") - F.col("first")) * 100.0 / F.col("first"), 1)).alias("rate"),
    )


def published_at(period: str = "period"):
    """A month's figures come out at the end of the month two later."""
    return F.last_day(F.add_months(F.to_date(F.concat(F.col(period), F.lit("-01"))), 2))


def annual_difference(df: DataFrame, keys: list[str], unit: float = 1.0) -> DataFrame:
    """A year's level minus that of the year before, in units; null where that year is missing."""
    before = df.select(*keys, (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return df.join(before, [*keys, "year"], "left").withColumn("difference", (F.col("value") - F.col("before")) / unit).drop("before")


def last_years(df: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """The rows of each key's n greatest years."""
    years = df.select(*keys, "year").distinct()
    best = years.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("year")))).where(F.col("_k") <= n).drop("_k")
    return df.join(best, [*keys, "year"], "left_semi")


def thirteen_months(df: DataFrame, keys: list[str]) -> DataFrame:
    """From the same month a year before a key's newest month, to that month."""
    newest = df.groupBy(*keys).agg(F.max("period").alias("_newest"))
    return df.join(newest, keys).where(F.col("period") >= shift_month(F.col("_newest"), -12)).drop("_newest")


def with_changes(levels: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Levels with the change printed for them; null (not 0) where none is."""
    return levels.join(changes.select(*keys, F.col("value").alias("change")), keys, "left")


def carried_year(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Rows (year, month) of printed tables name the year once: it is carried down until a blank row (both null)."""
    order = W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    blank = F.col("year").isNull() & F.col("month").isNull()
    blocks = rows.withColumn("_b", F.sum(blank.cast("int")).over(order))
    inside = W.partitionBy(*keys, "_b").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    year = F.last("year", ignorenulls=True).over(inside)
    return blocks.withColumn("period", F.when(F.col("month").isNotNull() & year.isNotNull(), F.format_string("%04d-%02d", year.cast("int"), F.col("month").cast("int")))).drop("_b")


def scale_of(df: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Whole percent of the greatest value in each group: one number per group is joined back."""
    most = df.groupBy(*keys).agg(F.max(value).alias("_most"))
    return df.join(most, keys).withColumn("scale", F.when(F.col("_most") > 0, round_half_up(F.col(value) * 100.0 / F.col("_most"))).otherwise(F.lit(0)).cast("long")).drop("_most")


def bar_geometry(df: DataFrame, keys: list[str], pad: float = 0.35) -> DataFrame:
    """Where a bar begins and ends, as a share of the axis: from zero if a group's values have both signs,
    else between the least and greatest value, padded by a share of their span."""
    ends = df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    signed = (F.col("_lo") < 0) & (F.col("_hi") > 0)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    zero = F.when(signed, -F.col("_lo") / span).otherwise(0.0)
    end = F.when(signed, (F.col("value") - F.col("_lo")) / span).otherwise((F.col("value") - F.col("_lo") + pad * span) / (span * (1 + 2 * pad)))
    return df.join(ends, keys).withColumns({"bar_start": zero, "bar_end": end}).drop("_lo", "_hi")


def with_releases(periods: DataFrame, posts: DataFrame, keys: list[str], board: Column) -> DataFrame:
    """Periods with the page that their figures were released on; where no post is known, the board's page."""
    return periods.join(posts, keys, "left").withColumn("url", F.coalesce("url", board))


def shared_periods(df: DataFrame, a: str, b: str) -> DataFrame:
    """The periods that both sources have."""
    held = df.groupBy("period").agg(F.bool_or(F.col("source") == a).alias("_a"), F.bool_or(F.col("source") == b).alias("_b"))
    return held.where("_a and _b").select("period")


def shown_names(df: DataFrame, names: DataFrame, left: str, right: str, out: str = "shown") -> DataFrame:
    """Rows with the short name of their organisation (names: right, name, short), or its whole one."""
    return df.join(names, F.col(left) == F.col(right), "left").withColumn(out, F.coalesce("short", "name")).drop("short", "name", right)
