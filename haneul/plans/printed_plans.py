"""Plans over printed lines, pages and words, beacons and registered sources: each table is laid out as what a source prints, in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import printed
from ..functions.dealing import dealt
from ..functions.storage import fresh_dir
from ..operators import printed as tables
from ..operators import quality, series, visits
from ..sinks.tables import Versions
from ..sources import files
from ..sources.registry import Collectors, DocumentSources
from ..streaming import beacons
from . import views
from .registry import Registry
from .source_plans import _arrays

R = Registry(views.VIEWS)
T = views.table

#: Lines of a document for each customer: its orders, of which some are headings.
_LINES = "(SELECT o_custkey AS doc, o_orderkey AS k, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Jobs report' WHEN '5' THEN 'Prices report' WHEN '3' THEN 'Appendix' ELSE '○ order ' || o_orderkey END AS line FROM orders)"


def _lines(spark, sf) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    line = F.when(first == "1", "Jobs report").when(first == "5", "Prices report").when(first == "3", "Appendix").otherwise(F.concat(F.lit("○ order "), "o_orderkey"))
    return T(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), line.alias("line"))


@R.add("k34_sections", f"SELECT doc, k, nullif(last_value(CASE line WHEN 'Jobs report' THEN 'Jobs' WHEN 'Prices report' THEN 'Prices' WHEN 'Appendix' THEN '' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k ROWS UNBOUNDED PRECEDING), '') AS section FROM {_LINES}")
def _(spark, sf):
    return tables.sections(_lines(spark, sf), ["doc"], ["Jobs", "Prices"], ["Appendix"]).select("doc", "k", "section")


@R.add("k25_summary_lines", f"""SELECT doc, CAST(place AS INT) AS place, line FROM (SELECT l.doc, row_number() OVER (PARTITION BY l.doc ORDER BY k) AS place, replace(line, '○ ', '') AS line FROM {_LINES} l
    JOIN (SELECT doc, min(k) AS a FROM {_LINES} WHERE line = 'Jobs report' GROUP BY 1) s ON s.doc = l.doc LEFT JOIN (SELECT l.doc, min(k) AS b FROM {_LINES} l JOIN (SELECT doc, min(k) AS a FROM {_LINES} WHERE line = 'Jobs report' GROUP BY 1) s ON s.doc = l.doc WHERE line = 'Appendix' AND k > a GROUP BY 1) e ON e.doc = l.doc
    WHERE k > a AND (b IS NULL OR k < b) AND line LIKE '○%') WHERE place <= 8""")
def _(spark, sf):
    return tables.summary_lines(_lines(spark, sf), ["doc"], F.col("line") == "Jobs report", F.col("line") == "Appendix")


_PAGES = "(SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page, o_orderkey AS k, o_orderstatus AS s FROM orders)"


def _pages(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W

    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return T(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), page.alias("page"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))


@R.add("k38_abstracts", f"""WITH p AS (SELECT doc, page, CASE WHEN s = 'F' THEN 'Report' ELSE 'Page ' || k END AS head, CASE k % 5 WHEN 0 THEN 'Summary' WHEN 1 THEN 'Chapter' ELSE 'words of ' || k END AS body FROM {_PAGES}), a AS (SELECT doc, min(page) AS a FROM p WHERE body = 'Summary' GROUP BY 1), b AS (SELECT p.doc, min(page) AS b FROM p JOIN a ON a.doc = p.doc WHERE body = 'Chapter' AND page > a GROUP BY 1),
    h AS (SELECT doc, head FROM p GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT p.doc, string_agg(CASE WHEN h.head IS NULL THEN p.head || chr(10) ELSE '' END || body, chr(10) ORDER BY page) AS abstract FROM p JOIN a ON a.doc = p.doc LEFT JOIN b ON b.doc = p.doc LEFT JOIN h ON h.doc = p.doc AND h.head = p.head WHERE page >= a AND (b IS NULL OR page < b) GROUP BY 1""")
def _(spark, sf):
    head = F.when(F.col("s") == "F", "Report").otherwise(F.concat(F.lit("Page "), "k"))
    body = F.when(F.col("k") % 5 == 0, "Summary").when(F.col("k") % 5 == 1, "Chapter").otherwise(F.concat(F.lit("words of "), "k"))
    pages = _pages(spark, sf).select("doc", "page", F.concat_ws("\n", head, body).alias("text"))
    return tables.abstracts(pages, ["doc"], F.col("text").endswith("Summary"), F.col("text").endswith("Chapter"))


@R.add("a22d_country_pages", f"SELECT p.doc, page FROM {_PAGES} p JOIN (SELECT doc, min(page) AS a FROM {_PAGES} WHERE s = 'P' GROUP BY 1) f ON f.doc = p.doc WHERE page = a OR page BETWEEN a + 1 AND a + 4 AND (s = 'P' OR k % 3 = 0)")
def _(spark, sf):
    text = F.when(F.col("s") == "P", "head\nKorea\nnote").when(F.col("k") % 3 == 0, "more on Korea").otherwise("others")
    return tables.country_pages(_pages(spark, sf).select("doc", "page", text.alias("text")), ["doc"], "Korea").select("doc", "page")


@R.add("k37_first_readable_page", f"SELECT doc, min(page) AS page FROM {_PAGES} WHERE 2020 + k % 9 >= 2020 + doc % 9 AND k % 4 > 0 GROUP BY 1")
def _(spark, sf):
    pages = _pages(spark, sf).select("doc", "page", F.array(F.lit("note"), (2020 + F.col("k") % 9).cast("string")).alias("columns"), F.when(F.col("k") % 4 > 0, F.array(F.lit(1.0))).otherwise(F.expr("CAST(array() AS array<double>)")).alias("figures"), (2020 + F.col("doc") % 9).alias("year"))
    columns = F.filter("columns", lambda c: c.rlike(r"^\d{4}$"))
    return tables.first_readable(pages, ["doc"], columns, F.col("figures"), F.col("year"))


_ROW = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus"


@R.add("k33_nearest_columns", f"SELECT page, n AS \"row\", 'c' || l_linestatus AS \"column\", CASE WHEN l_returnflag = 'A' THEN -l_quantity ELSE l_quantity END AS value FROM (SELECT *, l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ROW}) AS n FROM lineitem) WHERE l_linestatus <> 'O' OR l_quantity < 40")
def _(spark, sf):
    """A row per order line, with a figure within reach of a column or, for large quantities of open lines, beyond any."""
    from pyspark.sql import Window as W

    lines = T(spark, sf, "lineitem")
    li = dealt(lines.select("l_orderkey", *_ROW.split(", ")), lines.count(), "l_orderkey").withColumn("n", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ROW.split(", "))))
    at = F.when(F.col("l_linestatus") == "F", 100.0).when(F.col("l_quantity") < 40, 200.0).otherwise(300.0) + F.col("l_quantity") % 20
    figure = F.concat(F.when(F.col("l_returnflag") == "A", "△").otherwise(""), F.format_string("%.1f", "l_quantity"))
    words = F.array(F.struct(F.lit(0.0).alias("left"), F.lit("label").alias("text")), F.struct(at.alias("left"), figure.alias("text")))
    placed = li.select(F.col("l_orderkey").alias("page"), (F.col("n") * 12.0).alias("line"), F.explode(words).alias("w")).select("page", (F.col("line") + F.when(F.col("w.left") > 0, 2.0).otherwise(0.0)).alias("top"), "w.left", "w.text")
    heads = li.select(F.col("l_orderkey").alias("page")).distinct().withColumn("h", F.explode(F.array(F.struct(F.lit("cF").alias("column"), F.lit(110.0).alias("at")), F.struct(F.lit("cO").alias("column"), F.lit(210.0).alias("at")))))
    return tables.nearest_columns(tables.placed_words(placed, ["page"]), heads.select("page", "h.*"), ["page"])


@R.add("k28_summary_grid", "SELECT page, label, \"column\", value FROM (SELECT *, count(*) OVER (PARTITION BY page, label) AS n FROM (SELECT source || ':' || breakdown AS page, CASE WHEN category = '' THEN 'all' ELSE category END AS label, period[1:4] AS \"column\", round(sum(value), 1) AS value FROM observation WHERE series = 'headcount' AND period[1:4] IN ('1995', '1996', '1997') GROUP BY source, breakdown, category, period[1:4])) WHERE n = 3", ("observation",))
def _(spark, sf):
    """A line for each category with its sums of three years; a category without one of them has fewer figures and isn't a row."""
    o = views.observations(spark, sf).where("series = 'headcount' and substring(period, 1, 4) in ('1995', '1996', '1997')")
    label = F.when(F.col("category") == "", "all").otherwise(F.col("category"))
    page = F.concat_ws(":", "source", "breakdown").alias("page")
    sums = o.groupBy(page, label.alias("label"), F.substring("period", 1, 4).alias("year")).agg(F.format_number(F.sum("value"), 1).alias("v"))
    rows = sums.groupBy("page", "label").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "year", "v"))), " ").alias("v"))  # three years
    lines = rows.select("page", F.lit(1).alias("k"), F.concat_ws(" ", F.regexp_replace("label", r"[\d-]", "_"), F.regexp_replace("v", r"\d{4}\|", "")).alias("line"), "label")
    heads = rows.select("page").distinct().select("page", F.lit(0).alias("k"), F.lit("years 1995 1996 1997").alias("line"), F.lit("").alias("label"))
    found = tables.grid(lines.unionByName(heads).drop("label"), ["page"])
    names = lines.select(F.col("page").alias("_p"), F.regexp_replace("label", r"[\d-]", "_").alias("_l"), F.col("label").alias("whole"))
    return found.join(names, (F.col("page") == F.col("_p")) & (F.col("label") == printed.row_label(F.col("_l")))).select("page", F.col("whole").alias("label"), "column", "value")


@R.add("k21_unknown_acronyms", "SELECT doc_id, list_filter(regexp_extract_all(text || ' ' || upper(lang) || 'X', '[A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}') AND w NOT IN ('GDP', 'THE'))[1] AS word FROM documents WHERE text || lang IS NOT NULL")
def _(spark, sf):
    d = T(spark, sf, "documents").where("text is not null and lang is not null")
    return d.select("doc_id", printed.unknown_acronym(F.concat("text", F.lit(" "), F.upper("lang"), F.lit("X")), ["GDP", "THE"]).alias("word"))


@R.add("k22_quotes", "SELECT p_partkey, p_partkey % 4 = 0 AS said FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    source = F.concat(F.lit("The "), "p_name", F.lit(" costs\n a lot.\n\nEnd of "), "p_name")
    quote = F.when(k == 0, F.concat("p_name", F.lit("  costs a lot"))).when(k == 1, F.concat(F.lit("he "), "p_name")).when(k == 2, F.lit("a lot. End of")).otherwise("")
    return T(spark, sf, "part").select("p_partkey", printed.quoted(quote, source).alias("said"))


@R.add("a05_nested_folders", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS DOUBLE) AS value FROM orders")
def _(spark, sf):
    rows = T(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("value"), F.substring("o_orderpriority", 1, 1).alias("file"))
    return files.read_table(spark, _arrays(rows, "file"), "observation", recursive=True).select("id", "value")


_BEACONS = """(SELECT event_id AS id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type AS domain, '/' || event_type || '/:id' AS path, CAST(user_id AS VARCHAR) AS visitor, 's' || user_id AS session, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_type <> 'error')"""


def _beacons(spark, sf) -> DataFrame:
    e = T(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    visitor = F.when(F.col("event_id") % 13 == 0, F.repeat(F.lit("x"), 65)).otherwise(F.col("user_id").cast("string"))
    body = F.to_json(F.struct(F.col("event_type").alias("domain"), F.concat(F.lit("#/"), "event_type", F.lit("/"), "k").alias("path"), visitor.alias("visitor"), F.concat(F.lit("s"), "user_id").alias("session"), F.when(F.col("k") % 2 == 0, "https://www.google.com/q").alias("ref"), F.when(F.col("k") % 3 == 0, "standalone").alias("mode")))
    agent = F.when(F.col("event_id") % 7 == 0, "Googlebot/2.1").otherwise(views.pick(views.AGENTS, F.col("user_id") % 4))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(body).alias("body"), agent.alias("ua"), F.lit("KR").alias("country"))


@R.add("o01_beacons", f"SELECT id, day, domain, path, visitor, session, CASE WHEN k % 2 = 0 THEN 'google.com' END AS ref, CASE WHEN k % 2 = 0 THEN 'search' ELSE 'direct' END AS ref_kind, CASE WHEN k % 3 = 0 THEN 'standalone' ELSE 'browser' END AS mode, CASE user_id % 4 WHEN 0 THEN 'mobile' WHEN 2 THEN 'tablet' ELSE 'desktop' END AS device FROM {_BEACONS}")
def _(spark, sf):
    """Bots, bodies that aren't JSON, overlong visitors and domains that aren't listed are dropped."""
    return beacons.hits_of(_beacons(spark, sf), ["click", "view", "purchase", "signup", "search"]).select("id", "day", "domain", "path", "visitor", "session", "ref", "ref_kind", "mode", "device")


@R.add("a25_beacon_stream", f"SELECT day, domain, count(*) AS views FROM {_BEACONS} GROUP BY 1, 2")
def _(spark, sf):
    """The same beacons as a stream of files."""
    path, rows = fresh_dir(spark, "beacons"), _beacons(spark, sf)
    rows.write.parquet(path)
    hits = beacons.hits_of(spark.readStream.schema(rows.schema).parquet(path), ["click", "view", "purchase", "signup", "search"])
    return beacons.drain(beacons.daily_views(hits), spark, "complete")


@R.add("c10_coverage", "SELECT s.source, e.series, e.category FROM (SELECT unnest(['headcount', 'amount', 'rate']) AS series, unnest(['1-URGENT', '2-HIGH', '9-NONE']) AS category) e CROSS JOIN (SELECT DISTINCT source FROM observation) s WHERE NOT EXISTS (SELECT 1 FROM observation o WHERE o.source = s.source AND o.series = e.series AND o.category = e.category AND o.period = (SELECT max(period) FROM observation m WHERE m.source = s.source))", ("observation",))
def _(spark, sf):
    o = views.observations(spark, sf)
    expected = spark.createDataFrame([("headcount", "1-URGENT"), ("amount", "2-HIGH"), ("rate", "9-NONE")], "series string, category string")
    return quality.uncovered(o, o.select("source").distinct().join(F.broadcast(expected), F.lit(True)), ["series", "category"])  # three expected series


@R.add("e08_headcounts", "SELECT source, category, period, value FROM observation WHERE series = 'headcount' AND breakdown = 'priority' AND source = 'O' AND period >= '1996-01'", ("observation",))
def _(spark, sf):
    return series.observations(views.observations(spark, sf), "O", "priority", series="headcount", start="1996-01").select("source", "category", "period", "value")


@R.add("e11_whitelisted", f"SELECT domain, count(*) AS hits, count(DISTINCT visitor) AS visitors FROM {_BEACONS} WHERE domain IN ('click', 'view') GROUP BY 1")
def _(spark, sf):
    return beacons.hits_of(_beacons(spark, sf), ["click", "view"]).groupBy("domain").agg(F.count("*").alias("hits"), F.count_distinct("visitor").alias("visitors"))


@R.add("e13_within", f"SELECT 30 AS days, day, count(*) AS views FROM hit0 WHERE day BETWEEN '2024-01-01' AND '{views.TODAY_HITS}' GROUP BY 2 UNION ALL SELECT 0, day, count(*) FROM hit0 WHERE day BETWEEN '{visits.ALL_TIME}' AND '{views.TODAY_HITS}' GROUP BY 2", ("hit0",))
def _(spark, sf):
    hits, made = views.raw_hits(spark, sf), None
    for n in (30, 0):
        own = visits.within(hits, visits.window_of(views.TODAY_HITS, n)[0]).groupBy("day").agg(F.count("*").alias("views")).select(F.lit(n).alias("days"), "day", "views")
        made = own if made is None else made.unionByName(own)
    return made


@R.add("e19_folded_days", "SELECT p_partkey, CAST(CASE WHEN p_size IN (1, 7, 30, 90) THEN p_size WHEN p_size = 50 THEN NULL ELSE 30 END AS INT) AS days FROM part")
def _(spark, sf):
    """How long the window is that a request for p_size days gets; 50 stands for all time."""
    window = visits.windows_of(F.lit(views.TODAY_HITS), F.when(F.col("p_size") == 50, 0).otherwise(F.col("p_size")))
    whole = window["from"] == visits.ALL_TIME
    return T(spark, sf, "part").select("p_partkey", F.when(~whole, F.datediff(F.to_date(window["to"]), F.to_date(F.when(~whole, window["from"]))) + 1).alias("days"))


@R.add("p01_collectors", "SELECT name, ok, fetched FROM (SELECT 'orders' AS name, true AS ok, count(*) AS fetched FROM orders UNION ALL SELECT 'lines', true, count(*) FROM lineitem UNION ALL SELECT 'broken', false, 0)")
def _(spark, sf):
    known = Collectors()
    known.register("orders")(lambda s, today: T(s, sf, "orders").select(F.col("o_orderkey").alias("id")))
    known.register("lines")(lambda s, today: T(s, sf, "lineitem").select(F.col("l_orderkey").alias("id")))
    known.register("broken")(lambda s, today: T(s, sf, "no_such_table"))
    return known.run(spark, "2024-01-01")[1].select("name", "ok", "fetched")


@R.add("p02_document_pages", "SELECT doc_id, i AS page, strlen(p) AS bytes FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents WHERE lang = 'de' AND text IS NOT NULL))")
def _(spark, sf):
    """Pages of the chosen documents alone: those in German, a line a page."""
    sources = DocumentSources()
    described = lambda s: T(s, sf, "documents").where("text is not null").select("doc_id", "lang")
    paged = lambda s, chosen: T(s, sf, "documents").join(chosen, ["doc_id", "lang"], "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("page"), F.octet_length("p").alias("bytes"))
    sources.register("archive", described, paged)
    return sources.pages(spark, "archive", sources.documents(spark, "archive").where("lang = 'de'"))


@R.add("h28_header_columns", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN y || ':상반,' || y || ':하반,' || (y + 1) || ':연간' WHEN 1 THEN y || ':,' || (y + 1) || ':1Q,' || (y + 1) || ':2Q' ELSE y || ':,' || (y + 1) || ':' END AS columns FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def _(spark, sf):
    y = F.year("o_orderdate")
    text = lambda c: c.cast("string")
    header = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("(단위: %)  "), text(y), F.lit("년 상반 하반  "), text(y + 1), F.lit(" 연간"))).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(" ", text(y), text(y + 1), F.lit("1Q 2Q"))).otherwise(F.concat(text(y), F.lit("\t"), text(y + 1)))
    columns = F.transform(printed.header_columns(header), lambda c: F.concat(c["year"].cast("string"), F.lit(":"), F.coalesce(c["period"], F.lit(""))))
    return T(spark, sf, "orders").select("o_orderkey", F.array_join(columns, ",").alias("columns"))


@R.add("o06_merged_stream", "SELECT CAST(l_orderkey AS VARCHAR) AS id, max(strftime(l_shipdate, '%Y-%m')) AS released, arg_max(l_quantity, (strftime(l_shipdate, '%Y-%m'), l_quantity)) AS value FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Order lines as snapshots of their order, many of one key in a batch, merged from a stream that is run twice."""
    rows = T(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.date_format("l_shipdate", "yyyy-MM").alias("released"), F.col("l_quantity").alias("value"))
    path, root = fresh_dir(spark, "in"), fresh_dir(spark, "snapshots")
    rows.write.parquet(path)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(path)
        beacons.merge_snapshots(stream, spark, f"{root}/table", f"{root}/checkpoint", "id", "released", ["value"]).awaitTermination()
    return Versions(spark, f"{root}/table").read("id string, released string, value double")
