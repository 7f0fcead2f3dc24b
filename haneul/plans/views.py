"""Inputs of the plans, derived from the tables, each beside its SQL.

hit, owner: web visits from `events`. observation, sparse: monthly series from `orders` and
`lineitem`. forecast: vintages from `lineitem` and `part`. report, article: archives from
`documents`. They hold every row of their tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import local_day, month_of
from ..functions.text import device, referrer_kind
from ..operators import visits

#: The day that stands for today in plans over events, and in those over orders and forecasts.
TODAY_HITS, TODAY_ORDERS = "2024-01-30", "2001-08-15"
REFERRERS = ("www.google.com", "m.facebook.com", "news.example.org", None)
AGENTS = ("Mozilla/5.0 (iPhone) Mobile", "Mozilla/5.0 (Windows NT 10.0)", "Mozilla/5.0 (iPad)", "Mozilla/5.0 (Macintosh)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as visits, without sessions."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ref, ua = pick(REFERRERS, k % 4), pick(AGENTS, F.col("user_id") % 4)
    path = F.concat(F.lit("/"), "event_type", F.lit("/"), k.cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), local_day(F.col("ts")).alias("day"), F.col("event_type").alias("domain"), path.alias("path"), F.col("user_id").alias("visitor"),
        ref.alias("ref"), referrer_kind(ref).alias("ref_kind"), ua.alias("ua"), device(ua).alias("device"), F.when(k % 3 == 0, "standalone").otherwise("browser").alias("mode"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as visits; a session ends after 12 hours without one."""
    return visits.sessionize(raw_hits(spark, sf_dir), "visitor", "ts", "id", "12 hours")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitors that are left out: those that met error page 0."""
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.get_json_object("props", "$.k") == "0"))
    return e.select(F.col("user_id").alias("visitor")).distinct()


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits without owners."""
    return visits.without_owners(hits(spark, sf_dir), owners(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month: source is the order status, breakdowns are total, priority and segment of the customer."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    cuts = F.array(*(F.struct(F.lit(b).alias("breakdown"), c.alias("category")) for b, c in (("total", F.lit("")), ("priority", F.col("o_orderpriority")), ("segment", F.col("c_mktsegment")))))
    rows = rows.select(F.col("o_orderstatus").alias("source"), month_of(F.col("o_orderdate")).alias("period"), "o_totalprice", F.explode(cuts).alias("x"))
    made = rows.groupBy("source", "x.breakdown", "x.category", "period").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("p"))
    series = F.explode(F.array(F.struct(F.lit("headcount").alias("series"), F.col("n").cast("double").alias("value")), F.struct(F.lit("amount").alias("series"), F.col("p").cast("double").alias("value"))))
    return made.select("source", "breakdown", "category", "period", series.alias("s")).select("source", F.col("s.series"), "breakdown", "category", "period", F.col("s.value"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large order lines a month and supplier: series with gaps."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 48")
    return rows.groupBy(F.col("l_suppkey").alias("source"), month_of(F.col("l_shipdate")).alias("period")).agg(F.count("*").cast("double").alias("value"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vintage per order line: the supplier forecasts the part's brand; ord is the row's place in publication order."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    ord_ = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    half = F.when(F.col("p_size") % 3 == 0, "h1").when(F.col("p_size") % 3 == 1, "h2").otherwise("annual")
    return rows.select(ord_.alias("ord"), F.col("l_suppkey").alias("org"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published"), (F.year("l_shipdate") + F.pmod(F.col("l_partkey"), F.lit(2)).cast("int")).alias("year"), half.alias("half"), F.col("p_brand").alias("indicator"), F.col("l_quantity").alias("value"))


def first_line(text: Column) -> Column:
    return F.trim(F.split(F.coalesce(text, F.lit("")), "\n")[0])


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an archive: source is the board, the language the organisation, the first line the title."""
    d = table(spark, sf_dir, "documents")
    published = F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(2000)).cast("int")), "yyyy-MM-dd")
    return d.select("doc_id", F.col("lang").alias("org"), F.col("source").alias("board"), first_line(F.col("text")).alias("title"), F.col("text").alias("body"), published.alias("published"), "n_chars")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as news of a release on 2024-03-11: cited where the label says quality, published within 30 days."""
    r, labels = reports(spark, sf_dir), table(spark, sf_dir, "labels")
    day = F.pmod(F.col("doc_id"), F.lit(30)).cast("int")
    pub = F.date_format(F.date_add(F.lit("2024-03-11").cast("date"), day), "yyyy-MM-dd")
    return r.join(labels, "doc_id", "left").select("doc_id", "title", "body", F.col("board").alias("press"), pub.alias("pub"), (F.col("quality") == 1).alias("cites"), F.col("quality").isNotNull().alias("judged"), "toxic")


def _cases(values: tuple, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


_REF = _cases(REFERRERS, "k % 4")
VIEWS = {
    "hit0": f"""SELECT event_id AS id, ts, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type AS domain, '/' || event_type || '/' || k AS path, user_id AS visitor,
        {_REF} AS ref, CASE k % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'social' WHEN 2 THEN 'link' ELSE 'direct' END AS ref_kind,
        CASE user_id % 4 WHEN 0 THEN 'mobile' WHEN 2 THEN 'tablet' ELSE 'desktop' END AS device, CASE WHEN k % 3 = 0 THEN 'standalone' ELSE 'browser' END AS mode
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "hit1": "SELECT *, visitor || '-' || CAST(sum(fresh) OVER (PARTITION BY visitor ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY visitor ORDER BY ts, id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM hit0)",
    "owner": "SELECT DISTINCT user_id AS visitor FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k') = '0'",
    "hit": "SELECT * FROM hit1 WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE o.visitor = hit1.visitor)",
    "observation": """SELECT source, series, breakdown, category, period, CASE series WHEN 'headcount' THEN CAST(n AS DOUBLE) ELSE CAST(p AS DOUBLE) END AS value FROM (
        SELECT o_orderstatus AS source, breakdown, category, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS p FROM (
            SELECT o_orderstatus, o_orderdate, o_totalprice, 'total' AS breakdown, '' AS category FROM orders
            UNION ALL SELECT o_orderstatus, o_orderdate, o_totalprice, 'priority', o_orderpriority FROM orders
            UNION ALL SELECT o_orderstatus, o_orderdate, o_totalprice, 'segment', c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2, 3, 4), (VALUES ('headcount'), ('amount')) s(series)""",
    "sparse": "SELECT l_suppkey AS source, strftime(l_shipdate, '%Y-%m') AS period, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_quantity > 48 GROUP BY 1, 2",
    "forecast": "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_suppkey AS org, strftime(l_shipdate, '%Y-%m-%d') AS published, CAST(year(l_shipdate) + l_partkey % 2 AS INT) AS year, CASE p_size % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' ELSE 'annual' END AS half, p_brand AS indicator, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey",
    "report": "SELECT doc_id, lang AS org, source AS board, trim(split_part(coalesce(text, ''), chr(10), 1), ' ') AS title, text AS body, strftime(DATE '2021-01-01' + CAST((doc_id * 37) % 2000 AS INT), '%Y-%m-%d') AS published, n_chars FROM documents",
    "article": "SELECT r.doc_id, title, body, board AS press, strftime(DATE '2024-03-11' + CAST(r.doc_id % 30 AS INT), '%Y-%m-%d') AS pub, quality = 1 AS cites, quality IS NOT NULL AS judged, toxic FROM report r LEFT JOIN labels l ON r.doc_id = l.doc_id",
}
