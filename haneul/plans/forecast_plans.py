"""Plans over forecast vintages, their merges and the release calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasts, series, versioning
from . import views
from .registry import Registry

R = Registry(views.VIEWS)
FC = ("forecast",)
CHAIN = ["org", "indicator", "year", "half"]
TODAY = views.TODAY_ORDERS
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
_KEYS = "org, indicator, year, half"


@R.add("d04_revision_chain", f"SELECT *, round(value - prev_value, 2) AS revision FROM (SELECT *, lag(value) OVER (PARTITION BY {_KEYS} ORDER BY published, ord) AS prev_value FROM forecast)", FC)
def _(spark, sf):
    return forecasts.revision_chain(views.forecasts(spark, sf), CHAIN)


@R.add("h01_latest_per_org", "SELECT ord, org, published, year, half, indicator, value FROM (SELECT *, row_number() OVER (PARTITION BY org, indicator ORDER BY published DESC, ord) AS k FROM forecast) WHERE k = 1", FC)
def _(spark, sf):
    return forecasts.latest_per(views.forecasts(spark, sf), ["org", "indicator"])


def _parts(spark, sf):
    f = views.forecasts(spark, sf)
    return f.where("half = 'annual'"), f.where("half <> 'annual'")


_ASOF = "(SELECT arg_max(r.value, (r.published, -r.ord)) FROM forecast r WHERE r.half <> 'annual' AND r.org = l.org AND r.indicator = l.indicator AND r.published {op} l.published)"


@R.add("h05_latest_before", f"SELECT l.*, {_ASOF.format(op='<')} AS as_of_value FROM forecast l WHERE l.half = 'annual'", FC)
def _(spark, sf):
    return forecasts.as_of(*_parts(spark, sf), ["org", "indicator"], strict=True)


@R.add("f15_half_years_as_of", f"SELECT l.*, {_ASOF.format(op='<=')} AS as_of_value FROM forecast l WHERE l.half = 'annual'", FC)
def _(spark, sf):
    return forecasts.as_of(*_parts(spark, sf), ["org", "indicator"])


@R.add("e09_annual", "SELECT indicator, count(*) AS n FROM forecast WHERE coalesce(half, 'annual') = 'annual' GROUP BY 1", FC)
def _(spark, sf):
    return views.forecasts(spark, sf).where(F.coalesce("half", F.lit("annual")) == "annual").groupBy("indicator").agg(F.count("*").alias("n"))


@R.add("e15_from_publication_year", "SELECT year, count(*) AS n FROM forecast WHERE year >= CAST(published[1:4] AS INT) GROUP BY 1", FC)
def _(spark, sf):
    return views.forecasts(spark, sf).where(F.col("year") >= F.substring("published", 1, 4).cast("int")).groupBy("year").agg(F.count("*").alias("n"))


@R.add("e16_last_two_years", "SELECT org, year, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY org ORDER BY year DESC) AS k FROM forecast) WHERE k <= 2 GROUP BY 1, 2", FC)
def _(spark, sf):
    return series.last_years(views.forecasts(spark, sf), ["org"]).groupBy("org", "year").agg(F.count("*").alias("n"))


@R.add("g11_summarize", "SELECT indicator, year, count(*) AS n, floor(avg(value) * 10 + 0.5) / 10 AS mean, arg_max(org, (value, -ord)) AS max_org, max(value) AS max_value, arg_min(org, (value, ord)) AS min_org, min(value) AS min_value FROM forecast GROUP BY 1, 2", FC)
def _(spark, sf):
    return forecasts.summarize(views.forecasts(spark, sf), ["indicator", "year"])


@R.add("i01_compare_set", f"SELECT ord, org, published, year, half, indicator, value, CAST(DATE '{TODAY}' - CAST(published AS DATE) AS INT) AS age_days, CAST(DATE '{TODAY}' - CAST(published AS DATE) AS INT) BETWEEN 0 AND 7 AS is_new, CAST(DATE '{TODAY}' - CAST(published AS DATE) AS INT) > 90 AS is_stale FROM (SELECT *, row_number() OVER (PARTITION BY org, indicator ORDER BY published DESC, ord) AS k FROM forecast WHERE half = 'annual') WHERE k = 1", FC)
def _(spark, sf):
    newest = forecasts.latest_per(views.forecasts(spark, sf).where("half = 'annual'"), ["org", "indicator"])
    return forecasts.recency(newest, TODAY).orderBy(F.desc("value"), "ord")


@R.add("g22_timeline", "SELECT published[1:7] AS month, published, org, count(*) AS n_items, string_agg(indicator, ',' ORDER BY CAST(split_part(indicator, '#', 2) AS INT), ord) AS indicators FROM forecast GROUP BY 1, 2, 3", FC)
def _(spark, sf):
    return forecasts.timeline(views.forecasts(spark, sf), BRANDS)


@R.add("g33_indicator_order", "SELECT indicator, CAST(split_part(indicator, '#', 2) AS INT) AS place FROM forecast GROUP BY 1", FC)
def _(spark, sf):
    return views.forecasts(spark, sf).select("indicator").distinct().withColumn("place", F.array_position(F.array(*map(F.lit, BRANDS)), F.col("indicator")).cast("int"))


@R.add("h13_recency", f"SELECT count(*) AS n, count(*) FILTER (WHERE a BETWEEN 0 AND 7) AS fresh, count(*) FILTER (WHERE a > 90) AS stale FROM (SELECT DATE '{TODAY}' - CAST(published AS DATE) AS a FROM forecast)", FC)
def _(spark, sf):
    return forecasts.recency(views.forecasts(spark, sf), TODAY).agg(F.count("*").alias("n"), F.count_if("is_new").alias("fresh"), F.count_if("is_stale").alias("stale"))


@R.add("h17_overdue_by_gap", f"SELECT org, released, longest_gap, CAST(DATE '2001-12-01' - released AS INT) AS age FROM (SELECT org, max(d) AS released, CAST(max(gap) AS INT) AS longest_gap FROM (SELECT org, d, d - lead(d) OVER w AS gap, row_number() OVER w AS k FROM (SELECT DISTINCT org, CAST(published AS DATE) AS d FROM forecast) WINDOW w AS (PARTITION BY org ORDER BY d DESC)) WHERE k <= 4 GROUP BY 1) WHERE longest_gap IS NOT NULL AND DATE '2001-12-01' - released > longest_gap + 21", FC)
def _(spark, sf):
    return forecasts.overdue_by_gap(views.forecasts(spark, sf), "2001-12-01")


_WINDOWS = f"""(SELECT org, CASE WHEN over_ THEN s2 ELSE s1 END AS start, CASE WHEN over_ THEN e2 ELSE e1 END AS "end" FROM (SELECT *, e1 < DATE '{TODAY}' AS over_ FROM (
    SELECT org, CAST(make_date(2001, m, 1) + CAST(a - 4 AS INT) AS DATE) AS s1, CAST(make_date(2001, m, 1) + CAST(b + 2 AS INT) AS DATE) AS e1, CAST(make_date(2002, m, 1) + CAST(a - 4 AS INT) AS DATE) AS s2, CAST(make_date(2002, m, 1) + CAST(b + 2 AS INT) AS DATE) AS e2 FROM (
    SELECT org, CAST(month(d) AS INT) AS m, min(day(d)) AS a, max(day(d)) AS b FROM (SELECT DISTINCT org, CAST(published AS DATE) AS d FROM forecast) WHERE d BETWEEN DATE '{TODAY}' - 730 AND DATE '{TODAY}' GROUP BY 1, 2))))"""


@R.add("h18_expected_windows", f"SELECT * FROM {_WINDOWS}", FC)
def _windows(spark, sf):
    return forecasts.expected_windows(views.forecasts(spark, sf), TODAY)


_MERGED = f"""(SELECT org, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY org ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM (
    SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY org ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {{gap}} THEN 0 ELSE 1 END AS fresh FROM {_WINDOWS})) GROUP BY org, i)"""


@R.add("h19_merged_windows", f"SELECT * FROM {_MERGED.format(gap=5)}", FC)
def _(spark, sf):
    return forecasts.merge_windows(_windows(spark, sf), 5)


_NOTICES = "(SELECT DISTINCT org, CAST(published AS DATE) + 5 AS noticed FROM forecast WHERE value = 50)"


def _notices(spark, sf, name="noticed"):
    return views.forecasts(spark, sf).where("value = 50").select("org", F.date_add(F.to_date("published"), 5).alias(name)).distinct()


@R.add("f16_overdue_notices", f"SELECT n.org, noticed, released FROM {_NOTICES} n LEFT JOIN (SELECT org, max(published) AS released FROM forecast WHERE year < 1996 GROUP BY 1) r ON n.org = r.org WHERE released IS NULL OR noticed - CAST(released AS DATE) > 2", FC)
def _(spark, sf):
    return forecasts.overdue(views.forecasts(spark, sf).where("year < 1996"), _notices(spark, sf))


@R.add("f17_announced_dates", f"SELECT w.org, w.start, w.\"end\", min(n.noticed) AS announced FROM {_WINDOWS} w LEFT JOIN {_NOTICES} n ON n.org = w.org AND n.noticed BETWEEN w.start - 14 AND w.\"end\" + 14 GROUP BY 1, 2, 3", FC)
def _(spark, sf):
    return forecasts.attach_announced(_windows(spark, sf), _notices(spark, sf, "announced"))


@R.add("h21_next_date", f"SELECT org, min(noticed) AS next FROM {_NOTICES} WHERE noticed >= DATE '2001-06-01' GROUP BY 1", FC)
def _(spark, sf):
    return forecasts.next_date(_notices(spark, sf), ["org"], "2001-06-01", "noticed")


@R.add("h22_default_year", "SELECT org, indicator, coalesce(max(year) FILTER (WHERE year = 2001), max(year)) AS year FROM forecast GROUP BY 1, 2", FC)
def _(spark, sf):
    return forecasts.default_year(views.forecasts(spark, sf), ["org", "indicator"], 2001)


@R.add("i08_headline", "SELECT org, year_ AS y, indicator, CAST(place AS INT) AS place, year, value FROM (SELECT *, row_number() OVER (PARTITION BY org, year_ ORDER BY first, indicator) AS place FROM (SELECT org, CAST(published[1:4] AS INT) AS year_, indicator, min(ord) AS first, max(year) AS year, arg_max(value, (year, -ord)) AS value FROM forecast GROUP BY 1, 2, 3)) WHERE place <= 4", FC)
def _(spark, sf):
    return forecasts.headline(views.forecasts(spark, sf).withColumn("y", F.substring("published", 1, 4).cast("int")), ["org", "y"])


@R.add("c03_value_ranges", "SELECT ord, indicator, value, CASE indicator WHEN 'Brand#1' THEN value BETWEEN 10 AND 40 WHEN 'Brand#2' THEN value BETWEEN 0 AND 25 ELSE false END AS valid FROM forecast", FC)
def _(spark, sf):
    ranges = spark.createDataFrame([("Brand#1", 10.0, 40.0), ("Brand#2", 0.0, 25.0)], "indicator string, low double, high double")
    return forecasts.in_range(views.forecasts(spark, sf), ranges).select("ord", "indicator", "value", "valid")


@R.add("a27_unseen_recent", "SELECT org, published FROM (SELECT org, published, row_number() OVER (PARTITION BY org ORDER BY published DESC) AS k FROM (SELECT DISTINCT org, published FROM forecast)) r WHERE k <= 3 AND NOT EXISTS (SELECT 1 FROM forecast f WHERE f.org = r.org AND f.published = r.published AND f.value > 25)", FC)
def _(spark, sf):
    f = views.forecasts(spark, sf)
    return forecasts.unseen_recent(f, f.where("value > 25").select("org", "published"))


@R.add("f06_rationales", "SELECT f.ord, r.rationale FROM forecast f LEFT JOIN (SELECT org, published, indicator, 'because ' || CAST(min(ord) AS VARCHAR) AS rationale FROM forecast WHERE value > 30 GROUP BY 1, 2, 3) r USING (org, published, indicator)", FC)
def _(spark, sf):
    f = views.forecasts(spark, sf)
    why = f.where("value > 30").groupBy("org", "published", "indicator").agg(F.concat(F.lit("because "), F.min("ord").cast("string")).alias("rationale"))
    return forecasts.with_rationales(f, why).select("ord", "rationale")


_RELEASES = "(SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS release FROM orders WHERE day(o_orderdate) = 11)"


@R.add("h23_collection_kind", f"SELECT day, release, CASE WHEN CAST(day AS DATE) - CAST(release AS DATE) <= 1 THEN 'regular' WHEN CAST(day AS DATE) - CAST(release AS DATE) <= 22 THEN 'follow' ELSE 'none' END AS kind FROM (SELECT day, (SELECT max(release) FROM {_RELEASES} WHERE release <= day) AS release FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem))")
def _(spark, sf):
    days = views.table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).distinct()
    releases = views.table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 11).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("release")).distinct()
    return forecasts.collection_kind(days, releases)


# merges

_ID, _DAY_ID = "concat_ws('-', org, published[1:7], indicator, year, half)", "concat_ws('-', org, published, indicator, year, half)"
_STORED = f"(SELECT {_ID} AS id, arg_min(value, ord) AS value FROM forecast WHERE published < '2000-01-01' GROUP BY 1 UNION ALL SELECT {_DAY_ID}, arg_min(value, ord) + CAST(min(ord) % 2 AS INT) FROM forecast WHERE value > 40 AND published BETWEEN '1999-07-01' AND '1999-12-31' GROUP BY 1)"
_FRESH = f"(SELECT {_ID} AS id, {_DAY_ID} AS day_id, arg_min(value, ord) AS value FROM forecast WHERE published >= '1999-07-01' GROUP BY 1, 2)"


@R.add("d02_merge_vintages", f"""SELECT id, day_id, value, action, CASE WHEN action = 're-identified' THEN day_id ELSE id END AS stored_id FROM (SELECT n.*, CASE WHEN s.id IS NULL THEN 'added' WHEN s.value = n.value THEN 'skipped' WHEN d.id IS NULL THEN 're-identified' WHEN d.value = n.value THEN 'skipped' ELSE 'conflict' END AS action FROM {_FRESH} n LEFT JOIN {_STORED} s ON s.id = n.id LEFT JOIN {_STORED} d ON d.id = n.day_id)""", FC)
def _(spark, sf):
    id_ = lambda d: F.concat_ws("-", F.col("org").cast("string"), d, "indicator", F.col("year").cast("string"), "half")
    f = views.forecasts(spark, sf).withColumns({"id": id_(F.substring("published", 1, 7)), "day_id": id_(F.col("published"))})
    stored = f.where("published < '2000-01-01'").groupBy("id").agg(F.min_by("value", "ord").alias("value"))
    days = f.where("value > 40 and published between '1999-07-01' and '1999-12-31'").groupBy(F.col("day_id").alias("id")).agg((F.min_by("value", "ord") + F.min("ord") % 2).alias("value"))
    fresh = f.where("published >= '1999-07-01'").groupBy("id", "day_id").agg(F.min_by("value", "ord").alias("value"))
    return versioning.merge_vintages(stored.unionByName(days), fresh)


@R.add("d05_insert_absent", "SELECT org, published, indicator, value FROM (SELECT *, row_number() OVER (PARTITION BY org, published, indicator ORDER BY ord) AS k FROM forecast f WHERE NOT EXISTS (SELECT 1 FROM forecast g WHERE g.value > 30 AND g.org = f.org AND g.published = f.published AND g.indicator = f.indicator)) WHERE k = 1", FC)
def _(spark, sf):
    f = views.forecasts(spark, sf)
    return versioning.insert_absent(f.where("value > 30"), f, ["org", "published", "indicator"], "ord").select("org", "published", "indicator", "value")


_A, _B = "(SELECT o_custkey AS k, max(o_orderstatus) FILTER (WHERE o_orderstatus <> 'P') AS a, max(o_orderpriority) AS b FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1)", "(SELECT o_custkey AS k, max(o_orderstatus) AS a, min(o_orderpriority) AS b FROM orders WHERE o_orderdate >= '1997-01-01' GROUP BY 1)"


@R.add("d07_fill_missing", f"SELECT coalesce(x.k, y.k) AS k, coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b FROM {_A} x FULL JOIN {_B} y ON x.k = y.k")
def _(spark, sf):
    o = views.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    old = o.where("o_orderdate < '1998-01-01'").groupBy("k").agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("a"), F.max("o_orderpriority").alias("b"))
    new = o.where("o_orderdate >= '1997-01-01'").groupBy("k").agg(F.max("o_orderstatus").alias("a"), F.min("o_orderpriority").alias("b"))
    return versioning.fill_missing(old, new, "k")


@R.add("d08_schedule_merge", f"SELECT org, noticed, origin FROM (SELECT *, row_number() OVER (PARTITION BY org, noticed ORDER BY origin) AS k FROM (SELECT org, noticed, 'a-stored' AS origin FROM {_NOTICES} UNION ALL SELECT DISTINCT org, CAST(published AS DATE) + 5, 'b-fresh' FROM forecast WHERE value > 47)) WHERE k = 1 AND noticed >= DATE '2001-01-01' - 3", FC)
def _(spark, sf):
    fresh = views.forecasts(spark, sf).where("value > 47").select("org", F.date_add(F.to_date("published"), 5).alias("noticed")).distinct()
    return versioning.merge_schedules(_notices(spark, sf).withColumn("origin", F.lit("a-stored")), fresh.withColumn("origin", F.lit("b-fresh")), ["org", "noticed"], "noticed", "2001-01-01")


@R.add("b07_digest", "SELECT count(*) AS rows FROM part")
def _(spark, sf):
    return versioning.digest(views.table(spark, sf, "part"), ["p_partkey", "p_name", "p_retailprice"]).select("rows")
