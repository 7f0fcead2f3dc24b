"""Plans over monthly series, their checks and their keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.storage import fresh_dir
from ..operators import quality, series, versioning
from ..sinks import tables
from . import views
from .registry import Registry

R = Registry(views.VIEWS)
OBS, SPARSE = ("observation",), ("sparse",)
MONTH = "2000-06"
KEYS = ["source", "series", "breakdown", "category"]
_BACK = "strftime(CAST({p} || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m')"
_YOY = f"(SELECT a.*, a.value - b.value AS yoy FROM observation a LEFT JOIN observation b ON a.source = b.source AND a.series = b.series AND a.breakdown = b.breakdown AND a.category = b.category AND b.period = {_BACK.format(p='a.period')})"
_INDEX = "(CAST(period[1:4] AS INT) * 12 + CAST(period[6:7] AS INT) - 1)"


def _total(spark, sf, name="headcount"):
    return views.observations(spark, sf).where((F.col("series") == name) & (F.col("breakdown") == "total"))


@R.add("e01_observations", "SELECT * FROM observation WHERE source = 'F' AND breakdown = 'total' AND series = 'headcount' AND period BETWEEN '1996-01' AND '1998-12'", OBS)
def _(spark, sf):
    return series.observations(views.observations(spark, sf), "F", "total", series="headcount", start="1996-01", end="1998-12")


@R.add("e02_latest_inside_predicates", "SELECT o.* FROM observation o JOIN (SELECT source, series, breakdown, category, max(period) AS period FROM observation WHERE period <= '2000-06' AND value > 20 GROUP BY ALL) USING (source, series, breakdown, category, period) WHERE value > 20", OBS)
def _(spark, sf):
    return series.latest(views.observations(spark, sf).where("period <= '2000-06' and value > 20"), KEYS)


@R.add("h02_year_over_year", f"SELECT a.source, a.period, a.value, a.value - b.value AS yoy FROM sparse a LEFT JOIN sparse b ON a.source = b.source AND b.period = {_BACK.format(p='a.period')}", SPARSE)
def _(spark, sf):
    return series.year_over_year(views.sparse(spark, sf), ["source"])


@R.add("h03_annual_difference", "SELECT a.source, a.year, a.value, round((a.value - b.value) / 10, 6) AS difference FROM (SELECT source, CAST(period[1:4] AS INT) AS year, sum(value) AS value FROM sparse GROUP BY 1, 2) a LEFT JOIN (SELECT source, CAST(period[1:4] AS INT) AS year, sum(value) AS value FROM sparse GROUP BY 1, 2) b ON a.source = b.source AND a.year = b.year + 1", SPARSE)
def _(spark, sf):
    years = views.sparse(spark, sf).groupBy("source", F.substring("period", 1, 4).cast("int").alias("year")).agg(F.sum("value").alias("value"))
    return series.annual_difference(years, ["source"], 10.0).withColumn("difference", F.round("difference", 6))


@R.add("h06_contiguous_tail", f"SELECT source, period, value FROM (SELECT *, max(i) OVER (PARTITION BY source) AS last FROM (SELECT *, {_INDEX} + row_number() OVER (PARTITION BY source ORDER BY period DESC) AS i FROM sparse)) WHERE i = last", SPARSE)
def _(spark, sf):
    return series.contiguous_tail(views.sparse(spark, sf), ["source"])


@R.add("h07_last_points", "SELECT source, period, value FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY period DESC) AS k FROM sparse) WHERE k <= 5", SPARSE)
def _(spark, sf):
    return series.last_points(views.sparse(spark, sf), ["source"], 5)


@R.add("h08_fill_months", "SELECT m.source, m.period, s.value FROM (SELECT source, strftime(unnest(generate_series(CAST(min(period) || '-01' AS TIMESTAMP), CAST(max(period) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS period FROM sparse GROUP BY 1) m LEFT JOIN sparse s ON s.source = m.source AND s.period = m.period", SPARSE)
def _(spark, sf):
    return series.fill_months(views.sparse(spark, sf), ["source"])


@R.add("h11_month_shift", f"SELECT source, period, strftime(CAST(period || '-01' AS DATE) - INTERVAL 7 MONTH, '%Y-%m') AS shifted FROM sparse", SPARSE)
def _(spark, sf):
    return views.sparse(spark, sf).select("source", "period", dates.shift_month(F.col("period"), -7).alias("shifted"))


@R.add("h12_thirteen_months", f"SELECT s.* FROM sparse s JOIN (SELECT source, max(period) AS newest FROM sparse GROUP BY 1) m USING (source) WHERE period >= {_BACK.format(p='newest')}", SPARSE)
def _(spark, sf):
    return series.thirteen_months(views.sparse(spark, sf), ["source"])


@R.add("h24_reference_month", "SELECT DISTINCT published, strftime(date_trunc('month', CAST(published AS DATE)) - INTERVAL 1 MONTH, '%Y-%m') AS month FROM forecast", ("forecast",))
def _(spark, sf):
    return views.forecasts(spark, sf).select("published", dates.shift_month(F.substring("published", 1, 7), -1).alias("month")).distinct()


@R.add("h25_published_at", "SELECT DISTINCT period, strftime(last_day(CAST(period || '-01' AS DATE) + INTERVAL 2 MONTH), '%Y-%m-%d') AS published FROM observation", OBS)
def _(spark, sf):
    return views.observations(spark, sf).select("period", F.date_format(series.published_at(), "yyyy-MM-dd").alias("published")).distinct()


@R.add("h27_carried_year", "SELECT source, k, period FROM (SELECT source, k, month IS NULL AS blank, period FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY period) AS k, period, CAST(period[6:7] AS INT) AS month FROM sparse))", SPARSE)
def _(spark, sf):
    from pyspark.sql import Window as W

    rows = views.sparse(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("period")).cast("long"))
    year, before = F.substring("period", 1, 4).cast("int"), F.lag(F.substring("period", 1, 4)).over(W.partitionBy("source").orderBy("period"))
    printed = rows.select("source", "k", F.when(before.isNull() | (before != F.substring("period", 1, 4)), year).alias("year"), F.substring("period", 6, 2).cast("int").alias("month"))  # the year is printed once
    return series.carried_year(printed, ["source"], "k").select("source", "k", "period")


@R.add("g34_month_options", """SELECT strftime(unnest(generate_series(CAST((SELECT min(period) FROM (SELECT period FROM observation WHERE breakdown = 'total' AND series = 'headcount' GROUP BY 1 HAVING count(DISTINCT source) = 3)) || '-01' AS TIMESTAMP),
    CAST((SELECT max(period) FROM observation WHERE breakdown = 'total' AND series = 'headcount') || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS period""", OBS)
def _(spark, sf):
    return series.month_options(_total(spark, sf), 3)


_PROVIDED = "CASE source WHEN 'F' THEN true WHEN 'O' THEN breakdown = 'priority' WHEN 'P' THEN category NOT LIKE '5%' ELSE false END"
_CELLS = f"""(SELECT c.breakdown, c.category, s.source, CASE WHEN NOT ({_PROVIDED.replace('source', 's.source').replace('category', 'c.category').replace('breakdown', 'c.breakdown')}) THEN 'notProvided' WHEN o.value IS NULL THEN 'unpublished' WHEN o.yoy IS NULL THEN 'noDelta' ELSE 'value' END AS state, o.value, o.yoy
    FROM (SELECT DISTINCT breakdown, category FROM observation WHERE breakdown <> 'total') c CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(source) LEFT JOIN {_YOY} o ON o.source = s.source AND o.breakdown = c.breakdown AND o.category = c.category AND o.series = 'headcount' AND o.period = '@MONTH')"""


def _cells(spark, sf, period):
    obs = views.observations(spark, sf).where("series = 'headcount'")
    provided = F.create_map(F.lit("F"), F.lit(True), F.lit("O"), F.col("breakdown") == "priority", F.lit("P"), ~F.col("category").startswith("5"))
    categories = obs.where("breakdown <> 'total'").select("breakdown", "category").distinct().withColumn("provided", provided)
    return series.matrix(categories, series.year_over_year(obs, KEYS), ["F", "O", "P"], period)


@R.add("f04_matrix", f"SELECT * FROM {_CELLS.replace("@MONTH", MONTH)}", OBS)
def _(spark, sf):
    return _cells(spark, sf, MONTH)


@R.add("f05_cell_states", f"SELECT state, count(*) AS n FROM (SELECT * FROM {_CELLS.replace("@MONTH", "1995-06")} UNION ALL SELECT * FROM {_CELLS.replace("@MONTH", "2003-01")} UNION ALL SELECT * FROM {_CELLS.replace("@MONTH", MONTH)}) GROUP BY 1", OBS)
def _(spark, sf):
    cells = _cells(spark, sf, "1995-06").unionByName(_cells(spark, sf, "2003-01")).unionByName(_cells(spark, sf, MONTH))
    return cells.groupBy("state").agg(F.count("*").alias("n"))


@R.add("i02_matrix_by_change", f"""SELECT breakdown, category, max(yoy) FILTER (WHERE source = 'F') AS "F", max(yoy) FILTER (WHERE source = 'O') AS "O", max(yoy) FILTER (WHERE source = 'P') AS "P", coalesce(max(abs(yoy)), -1) AS max_abs FROM {_CELLS.replace("@MONTH", MONTH)} GROUP BY 1, 2""", OBS)
def _(spark, sf):
    return series.matrix_wide(_cells(spark, sf, MONTH), ["F", "O", "P"])


@R.add("i03_top_movers", f"SELECT breakdown, category, source, yoy, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY breakdown ORDER BY abs(yoy) DESC, source, category) AS place FROM {_YOY} WHERE series = 'headcount' AND period = '{MONTH}' AND yoy IS NOT NULL) WHERE place <= 3", OBS)
def _(spark, sf):
    obs = series.year_over_year(views.observations(spark, sf).where("series = 'headcount'"), KEYS).where(F.col("period") == MONTH)
    return series.top_movers(obs).select("breakdown", "category", "source", "yoy", "place")


_DERIVED = f"(SELECT * FROM observation WHERE series = 'headcount' AND (breakdown <> 'segment' OR period = '{MONTH}'))"


@R.add("m06_derive", f"""SELECT source, breakdown, shape, CASE shape WHEN 'cross-section' THEN total END AS sum, CASE WHEN shape = 'cross-section' AND total <> 0 THEN floor(most * 100.0 / total * 10 + 0.5) / 10 END AS top_share,
    CASE shape WHEN 'time-series' THEN l - f END AS diff, CASE WHEN shape = 'time-series' AND f <> 0 THEN floor((l - f) * 100.0 / f * 10 + 0.5) / 10 END AS rate FROM (
    SELECT source, breakdown, CASE WHEN p = 1 AND n > 1 THEN 'cross-section' WHEN p > 1 AND p = n THEN 'time-series' ELSE 'mixed' END AS shape, total, most, f, l FROM (
    SELECT source, breakdown, count(*) AS n, count(DISTINCT period) AS p, sum(value) AS total, max(value) AS most, arg_min(value, period) AS f, arg_max(value, period) AS l FROM {_DERIVED} GROUP BY 1, 2))""", OBS)
def _(spark, sf):
    rows = views.observations(spark, sf).where(F.expr(f"series = 'headcount' and (breakdown <> 'segment' or period = '{MONTH}')"))
    return series.derive(rows, ["source", "breakdown"])


@R.add("f22_levels_with_changes", f"SELECT a.source, a.category, a.period, a.value, b.yoy AS change FROM {_YOY} a LEFT JOIN {_YOY} b ON a.source = b.source AND a.category = b.category AND a.period = b.period AND b.series = 'headcount' AND b.breakdown = 'segment' AND b.yoy > 0 WHERE a.series = 'headcount' AND a.breakdown = 'segment'", OBS)
def _(spark, sf):
    obs = views.observations(spark, sf).where("series = 'headcount' and breakdown = 'segment'")
    changes = series.year_over_year(obs, KEYS).where("yoy > 0").select("source", "category", "period", F.col("yoy").alias("value"))
    return series.with_changes(obs.select("source", "category", "period", "value"), changes, ["source", "category", "period"])


@R.add("g29_scale", f"SELECT source, category, CAST(floor(value * 100.0 / max(value) OVER (PARTITION BY source) + 0.5) AS BIGINT) AS scale FROM observation WHERE series = 'headcount' AND breakdown = 'segment' AND period = '{MONTH}'", OBS)
def _(spark, sf):
    rows = views.observations(spark, sf).where(F.expr(f"series = 'headcount' and breakdown = 'segment' and period = '{MONTH}'"))
    return series.scale_of(rows, ["source"], "value").select("source", "category", "scale")


@R.add("k51_bar_geometry", f"""SELECT source, category, round(CASE WHEN lo < 0 AND hi > 0 THEN -lo / span ELSE 0 END, 6) AS bar_start, round(CASE WHEN lo < 0 AND hi > 0 THEN (yoy - lo) / span ELSE (yoy - lo + 0.35 * span) / (span * 1.7) END, 6) AS bar_end FROM (
    SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END AS span FROM (SELECT *, min(yoy) OVER w AS lo, max(yoy) OVER w AS hi FROM {_YOY} WHERE series = 'headcount' AND breakdown = 'segment' AND period = '{MONTH}' AND yoy IS NOT NULL WINDOW w AS (PARTITION BY source)))""", OBS)
def _(spark, sf):
    obs = series.year_over_year(views.observations(spark, sf).where("series = 'headcount' and breakdown = 'segment'"), KEYS).where(F.expr(f"period = '{MONTH}' and yoy is not null"))
    made = series.bar_geometry(obs.select("source", "category", F.col("yoy").alias("value")), ["source"])
    return made.select("source", "category", F.round("bar_start", 6).alias("bar_start"), F.round("bar_end", 6).alias("bar_end"))


@R.add("k44_round_half_up", "SELECT l_orderkey, l_linenumber, floor((l_extendedprice - 40000) / 1000 * 10 + 0.5) / 10 AS r FROM lineitem")
def _(spark, sf):
    price = (F.col("l_extendedprice") - 40000) / 1000
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_up(price, 1).alias("r"))


@R.add("k45_round_decimal", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice * l_discount AS DECIMAL(18,6)), 2) AS DOUBLE) AS r FROM lineitem")
def _(spark, sf):
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_decimal(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("r"))


@R.add("k48_unit_formats", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN format('{:,.1f}%p', l_quantity) WHEN 1 THEN format('{:,.0f}억원', l_quantity) WHEN 2 THEN format('{:,.2f}배', l_quantity) ELSE format('{:,.1f}만명', l_quantity / 10) END AS shown FROM lineitem")
def _(spark, sf):
    unit = views.pick(("%p", "억원", "배", "천명"), F.col("l_linenumber") % 4)
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_unit(F.col("l_quantity"), unit).alias("shown"))


@R.add("k55_parse_number", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS DOUBLE) AS n FROM orders")
def _(spark, sf):
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("명"))).otherwise(F.concat(F.format_number(F.col("o_custkey"), 0), F.lit(".5 ")))
    return views.table(spark, sf, "orders").select("o_orderkey", numbers.parse_number(shown).alias("n"))


@R.add("k56_part_of_month", "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 10 THEN '초' WHEN day(o_orderdate) <= 20 THEN '중순' ELSE '말' END AS part FROM orders")
def _(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", dates.part_of_month(F.dayofmonth("o_orderdate")).alias("part"))


@R.add("k40_publication_date", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN published WHEN 1 THEN strftime(last_day(CAST(published AS DATE)), '%Y-%m-%d') WHEN 2 THEN published[1:4] || '-12-31' END AS date, CASE doc_id % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS precision FROM report""", ("report",))
def _(spark, sf):
    p = F.col("published")
    given = F.when(F.col("doc_id") % 4 == 0, p).when(F.col("doc_id") % 4 == 1, F.substring(p, 1, 7)).when(F.col("doc_id") % 4 == 2, F.substring(p, 1, 4)).otherwise(F.concat(p, F.lit("?")))
    d = dates.publication_date(given)
    return views.reports(spark, sf).select("doc_id", F.date_format(d["date"], "yyyy-MM-dd").alias("date"), d["precision"].alias("precision"))


# checks


@R.add("c01_rules_report", "SELECT * FROM (SELECT 'period' AS rule, count(*) FILTER (WHERE NOT regexp_full_match(period, '[0-9]{4}-(0[1-9]|1[0-2])')) AS rows FROM observation UNION ALL SELECT 'category', count(*) FILTER (WHERE breakdown = 'total' AND category <> '' OR breakdown <> 'total' AND category = '') FROM observation UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM observation)", OBS)
def _(spark, sf):
    rules = quality.observation_rules()
    return quality.report(quality.judge(views.observations(spark, sf), rules), rules)


@R.add("c02_failed_rows", "SELECT source, period, CASE WHEN breakdown = 'total' THEN '' ELSE 'category' END AS failed, count(*) AS rows FROM observation GROUP BY 1, 2, 3", OBS)
def _(spark, sf):
    spoiled = views.observations(spark, sf).withColumn("category", F.lit(""))
    judged = quality.judge(spoiled, quality.observation_rules())
    return judged.groupBy("source", "period", F.array_join("failed", ",").alias("failed")).agg(F.count("*").alias("rows"))


@R.add("c04_page_urls", "SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://(sdmx|api)\\.') AND NOT regexp_matches(url, '^https?://[^/?#]+[^?#]*/(rest/data|api)/') AS ok FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", quality.is_page_url(F.col("url")).alias("ok"))


@R.add("c09_uncovered", "SELECT s.source, e.breakdown, e.category FROM (SELECT DISTINCT breakdown, category FROM observation) e CROSS JOIN (SELECT DISTINCT source FROM observation) s WHERE NOT EXISTS (SELECT 1 FROM observation o WHERE o.source = s.source AND o.breakdown = e.breakdown AND o.category = e.category AND o.period = (SELECT max(period) FROM observation m WHERE m.source = s.source))", OBS)
def _(spark, sf):
    obs = views.observations(spark, sf)
    expected = obs.select("source").distinct().crossJoin(F.broadcast(obs.select("breakdown", "category").distinct()))  # 3 sources, 11 categories
    return quality.uncovered(obs, expected, ["breakdown", "category"])


@R.add("c11_stale", f"SELECT source, max(period) AS newest, {2001 * 12 + 7} - max({_INDEX}) AS behind FROM sparse GROUP BY 1 HAVING behind > 2", SPARSE)
def _(spark, sf):
    return quality.stale(views.sparse(spark, sf), views.TODAY_ORDERS, 2, ["source"])


@R.add("c22_parts_sum", "SELECT source, series, period, t AS total, p AS parts FROM (SELECT source, series, period, sum(value) FILTER (WHERE breakdown = 'total') AS t, sum(value) FILTER (WHERE breakdown = 'priority' AND category <> '1-URGENT') AS p FROM observation GROUP BY 1, 2, 3) WHERE t IS NULL OR p IS NULL OR abs(t - p) > 5", OBS)
def _(spark, sf):
    short = views.observations(spark, sf).where("series = 'headcount' or series = 'amount'").where("category <> '1-URGENT'")
    return quality.parts_sum(short, ["source", "series", "period"], "priority", 5.0).withColumns({"total": F.round("total", 2), "parts": F.round("parts", 2)})


@R.add("c15_sheets_disagree", "SELECT a.source, a.period, a.value, b.value AS other FROM (SELECT source, period, sum(value) AS value FROM observation WHERE series = 'headcount' AND breakdown = 'priority' GROUP BY 1, 2) a JOIN (SELECT source, period, sum(value) AS value FROM observation WHERE series = 'headcount' AND breakdown = 'segment' AND category <> 'MACHINERY' GROUP BY 1, 2) b USING (source, period) WHERE abs(a.value - b.value) > 10", OBS)
def _(spark, sf):
    obs = views.observations(spark, sf).where("series = 'headcount'")
    sheet = lambda b, c: obs.where((F.col("breakdown") == b) & (F.col("category") != c)).groupBy("source", "period").agg(F.sum("value").alias("value"))
    return quality.disagreeing(sheet("priority", ""), sheet("segment", "MACHINERY"), ["source", "period"], 10.0)


@R.add("c16_newest_shared", "SELECT period, value, other, abs(value - other) <= 0.2 AS agrees FROM (SELECT a.period, a.value, b.value AS other FROM observation a JOIN observation b ON a.period = b.period AND a.source = 'F' AND b.source = 'O' AND a.breakdown = 'total' AND b.breakdown = 'total' AND a.series = 'headcount' AND b.series = 'headcount' ORDER BY 1 DESC LIMIT 1)", OBS)
def _(spark, sf):
    t = _total(spark, sf)
    return quality.newest_shared(t.where("source = 'F'"), t.where("source = 'O'"), 0.2)


@R.add("c14_rate_identity", "SELECT source, period, abs(yoy * 100 / nullif(value - yoy, 0) - printed) <= greatest(0.5, abs(printed) * 0.25) AS fits FROM (SELECT *, CASE WHEN CAST(period[6:7] AS INT) % 2 = 0 THEN round(yoy * 100 / (value - yoy), 1) ELSE 50.0 END AS printed FROM " + _YOY + " WHERE series = 'headcount' AND breakdown = 'total' AND yoy IS NOT NULL)", OBS)
def _(spark, sf):
    rows = series.year_over_year(_total(spark, sf), KEYS).where("yoy is not null")
    printed = F.when(F.substring("period", 6, 2).cast("int") % 2 == 0, F.round(F.col("yoy") * 100 / (F.col("value") - F.col("yoy")), 1)).otherwise(50.0)
    return rows.select("source", "period", quality.rate_fits(F.col("value"), F.col("yoy"), printed).alias("fits"))


@R.add("c18_known_down", "SELECT name, CASE WHEN NOT failing THEN 'recovered' WHEN deadline IS NULL THEN 'error' WHEN deadline < '2024-01-20' THEN 'expired' ELSE 'known' END AS verdict, failing AND deadline >= '2024-01-20' AND deadline IS NOT NULL AS passes FROM (SELECT name, bool_or(failing) AS failing, max(deadline) AS deadline FROM (SELECT 'u' || user_id AS name, true AS failing, NULL AS deadline FROM events WHERE event_type = 'error' AND value > 30 UNION ALL SELECT 'u' || user_id, false, max(strftime(ts, '%Y-%m-%d')) FROM events WHERE event_type = 'error' AND value < 1 GROUP BY 1) GROUP BY 1)")
def _(spark, sf):
    e = views.table(spark, sf, "events").where("event_type = 'error'").withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    known = e.where("value < 1").groupBy("name").agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("deadline"))
    return quality.gate(e.where("value > 30").select("name").distinct(), known, "2024-01-20")


@R.add("c19_blocked_too_long", "SELECT user_id AS source, max(strftime(ts, '%Y-%m-%d')) AS since, CAST(DATE '2024-01-30' - max(CAST(ts AS DATE)) AS INT) AS blocked_days FROM events WHERE event_type = 'click' GROUP BY 1 HAVING blocked_days >= 1")
def _(spark, sf):
    state = views.table(spark, sf, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("source")).agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("since"))
    return quality.blocked_too_long(state, "2024-01-30", 1)


# keyed merges


_RELEASED = "strftime(CAST(period || '-01' AS DATE) + INTERVAL 40 DAY, '%Y-%m-%d')"
_OLD = f"(SELECT source || '-' || period AS id, value, 'final' AS status, {_RELEASED} AS released FROM observation WHERE series = 'headcount' AND breakdown = 'total' AND period <= '2000-12')"
_NEW = f"(SELECT source || '-' || period AS id, value + CASE WHEN CAST(period[6:7] AS INT) % 3 = 0 THEN 1 ELSE 0 END AS value, 'final' AS status, CASE WHEN CAST(period[6:7] AS INT) % 4 = 0 THEN '1990-01-01' ELSE {_RELEASED} END AS released FROM observation WHERE series = 'headcount' AND breakdown = 'total' AND period >= '1999-06')"


def _versions(spark, sf):
    t = _total(spark, sf)
    released = F.date_format(F.date_add(F.to_date(F.concat("period", F.lit("-01"))), 40), "yyyy-MM-dd")
    month = F.substring("period", 6, 2).cast("int")
    id_ = F.concat_ws("-", "source", "period").alias("id")
    old = t.where("period <= '2000-12'").select(id_, "value", F.lit("final").alias("status"), released.alias("released"))
    new = t.where("period >= '1999-06'").select(id_, (F.col("value") + F.when(month % 3 == 0, 1).otherwise(0)).alias("value"), F.lit("final").alias("status"), F.when(month % 4 == 0, "1990-01-01").otherwise(released).alias("released"))
    return old, new


_UPSERT = f"""(SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' WHEN n.released < o.released THEN 'rejected' WHEN n.value = o.value AND n.status = o.status THEN 'unchanged' ELSE 'updated' END AS action, o.value AS ov, n.value AS nv, o.released AS "or", n.released AS nr FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id)"""


@R.add("d01_upsert_series", f"SELECT id, action, CASE WHEN action IN ('added', 'updated') THEN nv ELSE ov END AS value, 'final' AS status, CASE WHEN action IN ('added', 'updated') THEN nr ELSE \"or\" END AS released FROM {_UPSERT}", OBS)
def _(spark, sf):
    old, new = _versions(spark, sf)
    return versioning.upsert(old, new, "id", "released", ["value", "status"])


@R.add("b12_run_manifest", f"SELECT action, count(*) AS rows FROM {_UPSERT} GROUP BY 1", OBS)
def _(spark, sf):
    old, new = _versions(spark, sf)
    versions = tables.Versions(spark, fresh_dir(spark, "versions"))
    versions.write(old)
    counts = versions.upsert(new, "id", "released", ["value", "status"])  # observed while the merge is written
    return spark.createDataFrame(list(counts.items()), "action string, rows long")


@R.add("d01b_last_in_batch", "SELECT id, value, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY released DESC, ord DESC) AS k FROM (SELECT l_suppkey AS id, l_quantity AS value, strftime(l_shipdate, '%Y-%m') AS released, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)) WHERE k = 1")
def _(spark, sf):
    batch = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("value"), dates.month_of(F.col("l_shipdate")).alias("released"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return versioning.last_in_batch(batch, "id", "released", "ord").select("id", "value", "ord")


@R.add("b08_count_mismatches", "SELECT coalesce(a.d, b.d) AS domain, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual FROM (SELECT event_type AS d, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'gone', 3) a FULL JOIN (SELECT event_type AS d, count(*) AS n FROM events WHERE event_type <> 'error' OR value < 20 GROUP BY 1) b ON a.d = b.d WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def _(spark, sf):
    e = views.table(spark, sf, "events").withColumnRenamed("event_type", "domain")
    gone = spark.createDataFrame([("gone", 3)], "domain string, n long")
    counts = lambda df: df.groupBy("domain").agg(F.count("*").alias("n"))
    return versioning.count_mismatches(counts(e).unionByName(gone), counts(e.where("domain <> 'error' or value < 20")), "domain", ["click"])


@R.add("g30_largest_shard", "SELECT arg_max(event_type, (n, event_type)) AS shard, max(n) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(spark, sf):
    n = views.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("event_type", F.struct("n", "event_type")).alias("shard"), F.max("n").alias("n"))


@R.add("k19_mantissa", "SELECT o_orderkey, CASE WHEN v = 0 THEN 0.0 ELSE round(v / pow(10, floor(log10(v))), 5) END AS m FROM (SELECT o_orderkey, abs(CAST(o_custkey * 37 AS DOUBLE)) AS v FROM orders)")
def _(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", numbers.mantissa((F.col("o_custkey") * 37).cast("double")).alias("m"))
