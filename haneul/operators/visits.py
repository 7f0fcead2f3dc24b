"""Web-visit statistics over hits (id, ts, day, domain, path, visitor, session, ref, ref_kind).

Owners are left out by an anti join (a null owner removes nothing). Distinct counts are exact
and never summed across groups. A window is a pair of inclusive days; all time starts at
ALL_TIME. Statistics of one window come from one pass where they share a grain.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALL_TIME = "0000-01-01"
#: Fixed value: the window lengths that can be asked for; 0 is all time.
DAYS = (0, 1, 7, 30, 90)


def window_of(today: str, days: int | None) -> tuple[tuple[str, str], tuple[str, str] | None]:
    """The window of `days` days ending today, and the one before it (none for all time). Other lengths count as 30."""
    days = days if days in DAYS else 30
    if days == 0:
        return (ALL_TIME, today), None
    end = date.fromisoformat(today)
    start = end - timedelta(days - 1)
    return (start.isoformat(), today), ((start - timedelta(days)).isoformat(), (start - timedelta(1)).isoformat())


def windows_of(today: Column, days: Column) -> Column:
    """window_of() for columns: struct of from, to, prev_from and prev_to; the earlier window is null for all time."""
    n = F.when(days.isin(*DAYS), days).otherwise(30)
    end = F.to_date(today)
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    whole = n == 0
    return F.struct(F.when(whole, ALL_TIME).otherwise(text(F.date_sub(end, n - 1))).alias("from"), today.alias("to"), F.when(~whole, text(F.date_sub(end, 2 * n - 1))).alias("prev_from"), F.when(~whole, text(F.date_sub(end, n))).alias("prev_to"))


def sessionize(events: DataFrame, visitor: str, ts: str, key: str, gap: str = "12 hours") -> DataFrame:
    """Add `session`: a visitor's events without a pause longer than gap."""
    order = W.partitionBy(visitor).orderBy(ts, key)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(order)) > F.expr(f"interval {gap}"), F.lit(True))
    return events.withColumn("_new", new.cast("int")).withColumn("session", F.concat_ws("-", F.col(visitor).cast("string"), F.sum("_new").over(order).cast("string"))).drop("_new")


def without_owners(hits: DataFrame, owners: DataFrame) -> DataFrame:
    return hits.join(owners.select("visitor"), "visitor", "left_anti")


def within(hits: DataFrame, window: tuple[str, str]) -> DataFrame:
    return hits.where(F.col("day").between(*window))


def visitors(hits: DataFrame) -> DataFrame:
    """A row per visitor: first and last day, hits, and the first session (of the least id)."""
    return hits.groupBy("visitor").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("hits"), F.min_by("session", "id").alias("first_session"))


def summary(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("session").alias("sessions"), F.count("*").alias("views"))


def new_and_returning(hits: DataFrame, window: tuple[str, str]) -> DataFrame:
    """New: first seen in the window. Returning: more sessions in it than a new visitor's first one. Both may hold."""
    seen = within(hits, window).groupBy("visitor").agg(F.count_distinct("session").alias("sessions"))
    both = seen.join(visitors(hits).select("visitor", "first_day"), "visitor")
    new = F.col("first_day").between(*window)
    return both.agg(F.count_if(new).alias("new_visitors"), F.count_if(F.col("sessions") > new.cast("int")).alias("returning_visitors"))


def by_domain(hits: DataFrame) -> DataFrame:
    made = hits.groupBy("domain").agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("session").alias("sessions"), F.count("*").alias("views"))
    return made.orderBy(F.desc("visitors"), F.desc("views"), "domain")


def returning_by_domain(hits: DataFrame, window: tuple[str, str]) -> DataFrame:
    """Distinct visitors with a session in the window that isn't their first ever."""
    first = visitors(hits).select("visitor", "first_session")
    return within(hits, window).join(first, "visitor").where("session <> first_session").groupBy("domain").agg(F.count_distinct("visitor").alias("returning"))


def daily(hits: DataFrame) -> DataFrame:
    """Views and exact distinct visitors by (day, domain) and by day alone (domain null), one pass."""
    return hits.groupingSets([["day", "domain"], ["day"]], "day", "domain").agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))


def daily_assembled(hits: DataFrame) -> DataFrame:
    """A row per day: views by domain as a map, and exact visitors."""
    rows = daily(hits)
    made = rows.groupBy("day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("domain", "views"))))).alias("by_domain"), F.max(F.when(F.col("domain").isNull(), F.col("visitors"))).alias("visitors"))
    return made


def fill_days(rows: DataFrame, window: tuple[str, str], columns: list[str]) -> DataFrame:
    """A row for every day from the later of the window's start and the first day, zeros where nothing was; nothing in, nothing out."""
    bounds = rows.agg(F.min("day").alias("first")).where("first is not null").select(F.greatest(F.lit(window[0]), "first").alias("a"))
    days = bounds.select(F.explode(F.sequence(F.to_date("a"), F.to_date(F.lit(window[1])))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return days.join(rows, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def top_screens(hits: DataFrame, n: int = 20) -> DataFrame:
    made = hits.groupBy("domain", "path").agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))
    return made.orderBy(F.desc("views"), "domain", "path").limit(n)


def first_touch(hits: DataFrame) -> DataFrame:
    """A row per session: where its first hit (least id) came from."""
    return hits.groupBy("session").agg(F.min_by(F.struct("ref", "ref_kind"), "id").alias("f")).select("session", "f.ref", "f.ref_kind")


def distribution(hits: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Distinct visitors by a column's values that aren't null."""
    made = hits.where(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct("visitor").alias("visitors")).orderBy(F.desc("visitors"), column)
    return made.limit(n) if n else made


def compare_windows(hits: DataFrame, window: tuple[str, str], before: tuple[str, str] | None) -> DataFrame:
    """By domain: measures now and in the window before (0 where absent; null without such a window), one pass."""
    now = F.col("day").between(*window)
    was = F.col("day").between(*before) if before else F.lit(False)
    count = lambda c: F.count_if(c)
    distinct = lambda c, x: F.count_distinct(F.when(c, F.col(x)))
    made = hits.where(now | was).groupBy("domain").agg(count(now).alias("views"), distinct(now, "visitor").alias("visitors"), count(was).alias("p_views"), distinct(was, "visitor").alias("p_visitors")).where("views > 0")
    keep = lambda c: F.col(c) if before else F.lit(None).cast("long")
    return made.select("domain", "views", "visitors", keep("p_views").alias("prev_views"), keep("p_visitors").alias("prev_visitors"))


def capped(hits: DataFrame, cap: int = 500) -> DataFrame:
    """The first `cap` hits of a visitor's day."""
    order = W.partitionBy("visitor", "day").orderBy("ts", "id")
    return hits.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap).drop("_k")


def without_repeats(hits: DataFrame) -> DataFrame:
    """Views without those of the path seen just before in the session."""
    before = F.lag("path").over(W.partitionBy("session").orderBy("ts", "id"))
    return hits.withColumn("_p", before).where("_p is null or _p <> path").drop("_p")


def session_windows(hits: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Sessions by event time, for streams too."""
    made = hits.groupBy("visitor", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("views"))
    return made.select("visitor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "views")


def day_windows(hits: DataFrame) -> DataFrame:
    """Views by day at UTC+9: tumbling windows shifted by nine hours."""
    made = hits.groupBy(F.window("ts", "1 day", startTime="15 hours").alias("w"), "domain").agg(F.count("*").alias("views"))
    return made.select(F.date_format(F.col("w.start") + F.expr("interval 9 hours"), "yyyy-MM-dd").alias("day"), "domain", "views")


def elapsed_hours(run: Column, now: Column) -> Column:
    return F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(run)) / 3600), F.lit(0))
