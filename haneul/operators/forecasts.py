"""Forecast vintages: (ord, org, published, year, half, indicator, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import round_decimal, round_half_up


def revision_chain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each vintage with the value before it in its chain and the revision to two decimals; null (not 0) on the first."""
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("published", "ord"))
    return df.withColumn("prev_value", before).withColumn("revision", round_decimal(F.col("value") - F.col("prev_value"), 2))


def latest_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest vintage of each key; of equal dates the first row."""
    order = W.partitionBy(*keys).orderBy(F.desc("published"), "ord")
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """left with `as_of_value`: right's newest value published by (or, strict, before) left's date. Both
    sides are laid on one timeline per key and the last value is carried along: one shuffle, no pairs."""
    side = F.lit(0 if strict else 1)
    l = left.withColumns({"_side": side, "_v": F.lit(None).cast("double"), "_o": F.lit(None).cast("long")})
    r = right.select(*keys, "published", F.col("value").cast("double").alias("_v"), F.col("ord").alias("_o"), (F.lit(1) - side).alias("_side")).withColumn("_right", F.lit(True))
    line = l.unionByName(r, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("published", "_side", F.desc("_o")).rowsBetween(W.unboundedPreceding, 0)
    return line.withColumn("as_of_value", F.last("_v", ignorenulls=True).over(order)).where("_right is null").drop("_side", "_v", "_o", "_right")


def summarize(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean to one decimal, and who is highest and lowest (the first of equals)."""
    first_high, first_low = F.struct("value", (-F.col("ord")).alias("o")), F.struct("value", F.col("ord").alias("o"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), round_half_up(F.avg("value"), 1).alias("mean"), F.max_by("org", first_high).alias("max_org"), F.max("value").alias("max_value"), F.min_by("org", first_low).alias("min_org"), F.min("value").alias("min_value"))


def timeline(df: DataFrame, order: list[str]) -> DataFrame:
    """Month (newest first) by date and organisation, the indicators of each event in canonical order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("indicator"))
    items = F.sort_array(F.collect_list(F.struct(F.when(rank > 0, rank).otherwise(999).alias("k"), F.col("ord").alias("o"), "indicator")))
    made = df.groupBy(F.date_format("published", "yyyy-MM").alias("month"), F.col("published"), "org").agg(F.count("*").alias("n_items"), F.array_join(F.transform(items, lambda x: x["indicator"]), ",").alias("indicators"))
    return made.orderBy(F.desc("month"), F.desc("published"), "org")


def recency(df: DataFrame, today: str, new_days: int = 7, stale_days: int = 90) -> DataFrame:
    age = F.date_diff(F.to_date(F.lit(today)), F.to_date("published"))
    return df.withColumns({"age_days": age, "is_new": age.between(0, new_days), "is_stale": age > stale_days})


def expected_windows(df: DataFrame, today: str, margin: int = 3, back: int = 730) -> DataFrame:
    """From each organisation's releases of the last two years: for every month of the year in which it
    published, the days between its earliest and latest day there, widened by margin, next time it isn't over."""
    recent = df.select("org", F.to_date("published").alias("d")).distinct().where(F.col("d").between(F.date_sub(F.to_date(F.lit(today)), back), F.to_date(F.lit(today))))
    days = recent.groupBy("org", F.month("d").alias("m")).agg(F.min(F.dayofmonth("d")).alias("a"), F.max(F.dayofmonth("d")).alias("b"))
    year = int(today[:4])
    at = lambda y, d: F.date_add(F.make_date(F.lit(y), F.col("m"), F.lit(1)), F.col(d) - 1)
    start = lambda y: F.date_sub(at(y, "a"), margin)
    end = lambda y: F.date_add(at(y, "b"), margin)
    over = end(year) < F.to_date(F.lit(today))
    return days.select("org", F.when(over, start(year + 1)).otherwise(start(year)).alias("start"), F.when(over, end(year + 1)).otherwise(end(year)).alias("end"))


def merge_windows(windows: DataFrame, gap: int = 45) -> DataFrame:
    """Windows of an organisation less than gap days apart become one."""
    order = W.partitionBy("org").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = windows.withColumn("_new", F.coalesce((F.date_diff("start", reach) >= gap), F.lit(True)).cast("int"))
    return marked.withColumn("_i", F.sum("_new").over(order)).groupBy("org", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def overdue(df: DataFrame, notices: DataFrame, days: int = 2) -> DataFrame:
    """Notices newer than their organisation's latest release by more than `days`."""
    newest = df.groupBy("org").agg(F.max("published").alias("released"))
    return notices.join(newest, "org", "left").where(F.col("released").isNull() | (F.date_diff("noticed", "released") > days))


def in_range(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with `valid`: the value lies in its indicator's range; an indicator without range is not valid."""
    return df.join(ranges, "indicator", "left").withColumn("valid", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))


def overdue_by_gap(df: DataFrame, today: str, n: int = 4, margin: int = 21) -> DataFrame:
    """Organisations whose latest release is longer ago than their last n gaps and a margin allow."""
    days = df.select("org", F.to_date("published").alias("d")).distinct()
    newest_first = W.partitionBy("org").orderBy(F.desc("d"))
    gaps = days.withColumns({"gap": F.date_diff("d", F.lead("d").over(newest_first)), "_k": F.row_number().over(newest_first)}).where(F.col("_k") <= n)
    late = gaps.groupBy("org").agg(F.max("d").alias("released"), F.max("gap").alias("longest_gap"))
    age = F.date_diff(F.to_date(F.lit(today)), "released")
    return late.withColumn("age", age).where(F.col("longest_gap").isNotNull() & (F.col("age") > F.col("longest_gap") + margin))


def attach_announced(windows: DataFrame, announced: DataFrame, margin: int = 14) -> DataFrame:
    """Windows with the first announced date of their organisation from `margin` days before to `margin` days after."""
    near = F.col("announced").between(F.date_sub("start", margin), F.date_add("end", margin))
    found = windows.join(announced, "org").where(near).groupBy("org", "start", "end").agg(F.min("announced").alias("announced"))
    return windows.join(found, ["org", "start", "end"], "left")


def next_date(dates: DataFrame, keys: list[str], today: str, column: str) -> DataFrame:
    """The earliest date from today on."""
    return dates.where(F.col(column) >= today).groupBy(*keys).agg(F.min(column).alias("next"))


def default_year(df: DataFrame, keys: list[str], this_year: int) -> DataFrame:
    """This year where there are figures for it, else the greatest."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("year") == this_year, F.col("year"))), F.max("year")).alias("year"))


def headline(df: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """Per event, the figure of the greatest year for each of the first n indicators in order of appearance."""
    best = df.groupBy(*keys, "indicator").agg(F.min("ord").alias("first"), F.max_by(F.struct("year", "value"), F.struct("year", (-F.col("ord")).alias("o"))).alias("b"))
    return best.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("first", "indicator"))).where(F.col("place") <= n).select(*keys, "indicator", "place", F.col("b.year").alias("year"), F.col("b.value").alias("value"))


def unseen_recent(issues: DataFrame, known: DataFrame, n: int = 3) -> DataFrame:
    """The latest n issue dates of each organisation that aren't stored yet."""
    days = issues.select("org", "published").distinct()
    recent = days.withColumn("_k", F.row_number().over(W.partitionBy("org").orderBy(F.desc("published")))).where(F.col("_k") <= n).drop("_k")
    return recent.join(known, ["org", "published"], "left_anti")


def with_rationales(df: DataFrame, rationales: DataFrame) -> DataFrame:
    """Forecasts with the text given for their organisation, date and indicator, whatever the year."""
    return df.join(rationales.select("org", "published", "indicator", "rationale"), ["org", "published", "indicator"], "left")


def collection_kind(days: DataFrame, releases: DataFrame, day: str = "day") -> DataFrame:
    """Days with the latest release on or before them and what to collect: regular within a day, follow-ups
    until day 22, else nothing. Releases and days meet on one timeline."""
    line = days.select(F.col(day).alias("_d"), F.lit(1).alias("_side")).unionByName(releases.select(F.col("release").alias("_d"), F.lit(0).alias("_side")))
    month = F.substring("_d", 1, 7)  # a release is looked for in this month's rows and, through carried values, in earlier months
    within = W.partitionBy("_m").orderBy("_d", "_side").rowsBetween(W.unboundedPreceding, 0)
    rel = F.when(F.col("_side") == 0, F.col("_d"))
    placed = line.withColumn("_m", month).withColumn("_r", F.last(rel, ignorenulls=True).over(within))
    months = placed.groupBy("_m").agg(F.max(rel).alias("_last"))  # a row per month
    before = months.withColumn("_carry", F.last("_last", ignorenulls=True).over(W.orderBy("_m").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    found = placed.where("_side = 1").join(F.broadcast(before), "_m", "left").withColumn("release", F.coalesce("_r", "_carry"))
    gap = F.date_diff(F.to_date("_d"), F.to_date("release"))
    return found.select(F.col("_d").alias(day), "release", F.when(gap <= 1, "regular").when(gap <= 22, "follow").otherwise("none").alias("kind")).distinct()


def backfill(stored: DataFrame, rounds: DataFrame, since: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Past rounds laid under what is stored: rows of rounds from `since` on whose (keys, published) isn't stored,
    of repeats the first, with all revisions computed anew; and per round how many rows were added, or that it was
    there already. The chains are ordered by date, so rounds may come in any order, all at once."""
    same = [*keys, "published"]
    late = rounds.where(F.col("published") >= since)
    first = W.partitionBy(*same).orderBy("ord")
    new = late.join(stored.select(*same).distinct(), same, "left_anti").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    counts = late.select("org", "published").distinct().join(new.groupBy("org", "published").agg(F.count("*").alias("added")), ["org", "published"], "left")
    return revision_chain(stored.unionByName(new.select(*stored.columns)), keys), counts.na.fill(0, ["added"])


def newest_supplement(latest: DataFrame, posts: DataFrame, kind: str = "hwpx") -> DataFrame:
    """Of each source the post (period, url, released, attachments of (type, url)) of its newest period, if that is
    later than the latest one held, and has a release date and a file of the kind; the first such file."""
    newest = posts.groupBy("source").agg(F.max_by(F.struct("period", "url", "released", "attachments"), "period").alias("p"))
    j = newest.join(latest, "source").where(F.col("p.period") > F.col("latest"))
    file = F.get(F.filter("p.attachments", lambda a: a["type"] == kind), F.lit(0))["url"]
    return j.select("source", "p.period", "p.url", "p.released", file.alias("file")).where("file is not null and released is not null")


def grouped_reports(df: DataFrame, keys: list[str]) -> DataFrame:
    """A report (keys) with how many figures it gives and their indicators in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("ord", "indicator"))), lambda x: x["indicator"])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(items, ",").alias("indicators"))


def targets_in_order(df: DataFrame, keys: list[str], halves: tuple[str, ...] = ("annual", "h1", "h2")) -> DataFrame:
    """The years and halves that each group forecasts, by year, the whole year first."""
    rank = F.array_position(F.array(*map(F.lit, halves)), F.col("half"))
    items = F.sort_array(F.collect_set(F.struct("year", rank.alias("rank"), "half")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: F.concat(x["year"].cast("string"), x["half"])), ",").alias("shown"))
