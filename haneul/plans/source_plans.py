"""Plans over readers, sinks and states of runs: tables are laid out as the files that a source would give, in the
shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import printed
from ..functions.dates import month_of
from ..functions.storage import fresh_dir
from ..operators import status, visits
from ..sinks import office as office_sink
from ..sinks import tables
from ..sources import files, office_source, schemas
from . import views
from .registry import Registry

R = Registry(views.VIEWS)
T = views.table
OBS, FC = ("observation",), ("forecast",)
#: Files that the fixtures write for each group of records.
PARTS = 8


def _texts(*frames: DataFrame) -> str:
    """A folder with a text file (or several) for each frame, whose names sort in the frames' order."""
    path = fresh_dir(frames[0].sparkSession, "files")
    whole = frames[0].withColumn("k", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        whole = whole.union(f.withColumn("k", F.lit(k)))
    whole.repartitionByRange(len(frames), "k").select("value").write.text(path)
    return path


def _arrays(df: DataFrame, file: str) -> str:
    """A folder of JSON arrays of the rows, in several files for each value of `file`, PARTS at most."""
    path = fresh_dir(df.sparkSession, "files")
    own = [c for c in df.columns if c != file]
    records = F.to_json(F.collect_list(F.struct(*own)))
    parts = df.withColumn("part", F.pmod(F.xxhash64(*own), F.lit(PARTS))).groupBy(file, "part").agg(records.alias("value"))
    parts.write.partitionBy(file, "part").text(path)
    return path


def _ids(o: DataFrame) -> DataFrame:
    return o.withColumn("id", F.concat_ws("-", "source", "series", "breakdown", "category", "period"))


_ID = "concat_ws('-', source, series, breakdown, category, period) AS id"


@R.add("a01_forecasts_of_files", "SELECT CAST(ord AS VARCHAR) AS id, CAST(org AS VARCHAR) AS org, CAST(published AS DATE) AS published_at, year AS target_year, value FROM forecast", FC)
def _(spark, sf):
    f = views.forecasts(spark, sf)
    rows = f.select(F.col("ord").cast("string").alias("id"), F.col("org").cast("string").alias("org"), F.col("published").alias("published_at"), F.col("year").alias("target_year"), "value", F.substring("published", 1, 7).alias("file"))
    return files.read_table(spark, _arrays(rows, "file"), "forecast", recursive=True).select("id", "org", "published_at", "target_year", "value")


@R.add("a02_unique_series", f"SELECT {_ID}, value FROM observation", OBS)
def _(spark, sf):
    rows = _ids(views.observations(spark, sf)).withColumn("file", F.col("source"))
    return files.read_unique(spark, _arrays(rows, "file") + "/*/*", "observation").select("id", "value")


@R.add("a03_overrides", "SELECT n_name AS id, CAST(n_nationkey + CASE WHEN n_regionkey < 3 THEN 100 ELSE 0 END AS DOUBLE) AS value FROM nation")
def _(spark, sf):
    n = T(spark, sf, "nation")
    array = lambda df, more: df.agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("id"), (F.col("n_nationkey") + more).cast("double").alias("value")))).alias("value"))
    return files.read_overrides(spark, _texts(array(n, 0), array(n.where("n_regionkey < 3"), 100)), "observation").select("id", "value")


@R.add("a04_sharded_texts", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'de' THEN 'later ' ELSE '' END || text AS text FROM documents")
def _(spark, sf):
    """Whole texts, in PARTS shards for each language; those of one language come again, changed, in shards named later."""
    d = T(spark, sf, "documents").withColumn("part", F.pmod("doc_id", F.lit(PARTS)).cast("string"))
    later = d.where("lang = 'de'").withColumns({"text": F.concat(F.lit("later "), "text"), "lang": F.lit("zz")})
    shard = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "text"))), {"ignoreNullFields": "false"})
    shards = d.unionByName(later).groupBy(F.concat(F.coalesce("lang", F.lit("")), "part").alias("k")).agg(shard.alias("value"))
    path = fresh_dir(spark, "files")
    shards.repartitionByRange(50 * PARTS, "k").select("value").write.text(path)  # far more ranges than shards: a file each, named in their order
    return files.read_shards(spark, path)


@R.add("a06_flattened_releases", "SELECT o_orderstatus || '-' || m AS id, o_orderstatus AS source, m AS month, 'post ' || k AS title, CAST(m || '-20' AS DATE) AS posted_at FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS m, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)")
def _(spark, sf):
    months = T(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s"), month_of(F.col("o_orderdate")).alias("m")).agg(F.min("o_orderkey").alias("k"))
    post = F.struct(F.concat(F.lit("post "), "k").alias("title"), F.concat("m", F.lit("-20")).alias("posted_at"))
    by_source = months.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("m", post))).alias("v"))
    made = by_source.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("s", "v")))).alias("value"))
    return files.read_releases(spark, _texts(made)).select("id", "source", "month", "title", "posted_at")


@R.add("a07_rounds_on_disk", "SELECT strftime(o_orderdate, '%Y-%m') AS release, list_sort(list(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'follow' ELSE 'regular' END)) AS kinds FROM orders GROUP BY 1")
def _(spark, sf):
    path = fresh_dir(spark, "rounds")
    o = T(spark, sf, "orders").select(month_of(F.col("o_orderdate")).alias("release"), F.when(F.col("o_orderkey") % 2 == 0, "follow").otherwise("regular").alias("kind"), F.lit("{}").alias("value"))
    o.distinct().write.partitionBy("release", "kind").text(path)
    return files.rounds_on_disk(spark, path, r"release=([^/]+)/kind=([a-z]+)/")


@R.add("a15_sdmx_csv", "SELECT category AS measure, CAST(period[1:4] AS INT) AS year, value FROM observation WHERE source = 'F' AND breakdown = 'segment' AND series = 'amount'", OBS)
def _(spark, sf):
    path = fresh_dir(spark, "csv")
    o = views.observations(spark, sf).where("breakdown = 'segment'")
    cell = F.when(F.col("series") == "amount", F.col("value").cast("string")).otherwise(" ")
    o.select(F.col("source").alias("REF_AREA"), F.lit("A").alias("FREQ"), F.col("category").alias("MEASURE"), F.substring("period", 1, 4).alias("TIME_PERIOD"), cell.alias("OBS_VALUE")).write.option("header", True).csv(path)
    return files.read_sdmx_csv(spark, path, "F")


@R.add("a16_sdmx_json", "SELECT source AS series, period, value FROM observation WHERE breakdown = 'total' AND series = 'headcount'", OBS)
def _(spark, sf):
    o = views.observations(spark, sf).where("breakdown = 'total' and series = 'headcount'")
    values = F.array_sort(F.collect_set("period"))
    cells = F.map_from_entries(F.collect_list(F.struct((F.array_position("periods", F.col("period")) - 1).cast("string"), F.array(F.col("value").cast("string")))))
    held = o.crossJoin(F.broadcast(o.agg(values.alias("periods")))).groupBy("source", "periods").agg(cells.alias("cells"))  # one row of periods
    names = F.transform("periods", lambda p: F.struct(p.alias("value")))
    made = held.groupBy("periods").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct(F.col("cells").alias("observations"))))).alias("s"))
    body = F.struct(F.struct(F.array(F.struct(F.struct(F.array(F.struct(names.alias("values"))).alias("observation")).alias("dimensions"))).alias("structures"), F.array(F.struct(F.col("s").alias("series"))).alias("dataSets")).alias("data"))
    return files.read_sdmx_json(spark, _texts(made.select(F.to_json(body).alias("value"))))


@R.add("a17_sdmx_xml", "SELECT period, CASE WHEN period >= '1993' THEN value END AS value FROM observation WHERE source = 'F' AND breakdown = 'total' AND series = 'headcount'", OBS)
def _(spark, sf):
    o = views.observations(spark, sf).where("source = 'F' and breakdown = 'total' and series = 'headcount'")
    cell = F.when(F.col("period") >= "1993", F.col("value").cast("string")).otherwise("")
    return files.read_sdmx_xml(spark, _texts(o.select(F.concat(F.lit('<m:Obs TIME_PERIOD="'), "period", F.lit('" OBS_VALUE="'), cell, F.lit('"/>')).alias("value"))))


@R.add("a10_vintages_of_wide", "SELECT p_partkey, v AS vintage, CASE v WHEN 'S2024' THEN CAST(p_size AS DOUBLE) WHEN 'F2024' THEN CASE WHEN p_size % 2 = 0 THEN p_size + 0.5 END END AS value FROM part, (VALUES ('S2024'), ('F2024'), ('S2025')) x(v)")
def _(spark, sf):
    p = T(spark, sf, "part")
    wide = p.select("p_partkey", F.col("p_size").cast("string").alias("S2024"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 0.5).cast("string")).otherwise(".").alias("F2024"), F.lit(" ").alias("S2025"))
    return files.vintages_of_wide(wide, ["p_partkey"])


@R.add("a18_statistics_rows", "SELECT 'est' AS source, o_orderstatus AS series, o_orderpriority AS breakdown, 'all' AS category, strftime(o_orderdate, '%Y-%m') AS period, CAST(round(CAST(floor(o_totalprice) AS DECIMAL(15, 0)) * 0.001, 1) AS DOUBLE) AS value FROM orders")
def _(spark, sf):
    o = T(spark, sf, "orders")
    rows = o.select(F.col("o_orderpriority").alias("C1"), F.lit("all").alias("C2_NM"), F.col("o_orderstatus").alias("ITM_ID"), F.date_format("o_orderdate", "yyyyMM").alias("PRD_DE"), F.format_number(F.floor("o_totalprice"), 0).alias("DT"))
    return files.series_of_rows(rows, "est")


@R.add("a19_feed_items", "SELECT p_name AS title, 'd' || p_size AS date, 'http://b/' || p_partkey AS url FROM part WHERE p_size % 2 = 0")
def _(spark, sf):
    p = T(spark, sf, "part")
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<![CDATA["), "p_name", F.lit("]]>"))).otherwise("0 none")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://b/"), "p_partkey", F.lit("</link><pubDate>d"), "p_size", F.lit("</pubDate></item>"))
    return files.read_rss(spark, _texts(p.select(item.alias("value"))), "^(?!0 none)")


@R.add("a20_listed_posts", "SELECT o_orderkey, 'no ' || o_orderpriority || ' ' || strftime(o_orderdate, '%Y.%m.%d') AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, '/v?id=' || o_orderkey AS link FROM orders WHERE contains(o_orderpriority, 'URG')")
def _(spark, sf):
    o = T(spark, sf, "orders")
    row = F.concat(F.lit("<tr><td>no</td><td><a href='/v?id="), "o_orderkey", F.lit("'>"), "o_orderpriority", F.lit("</a></td><td>"), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit("</td></tr><TR><td>else</td></TR>"))
    return files.list_rows(o.select("o_orderkey", row.alias("html")), "html", "URG").select("o_orderkey", "title", "date", "link")


@R.add("a22e_first_per_period", "SELECT o_orderstatus AS source, strftime(o_orderdate, '%Y-%m') AS period, min(o_orderkey) AS page FROM orders GROUP BY 1, 2")
def _(spark, sf):
    posts = T(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), month_of(F.col("o_orderdate")).alias("period"), F.col("o_orderkey").alias("page"))
    return files.first_per_period(posts, "page")


_ITEMS = "(SELECT source AS board, doc_id // 20 AS page, doc_id AS id, strftime(DATE '2021-01-01' + CAST(2000 - doc_id % 2000 AS INT), '%Y-%m-%d') AS date FROM documents)"


@R.add("a26_crawled", f"SELECT i.board, i.page, i.id, i.date FROM {_ITEMS} i LEFT JOIN (SELECT board, min(page) AS stop FROM (SELECT board, page FROM {_ITEMS} LEFT JOIN labels l ON l.doc_id = id GROUP BY 1, 2 HAVING bool_and(l.doc_id IS NOT NULL)) GROUP BY 1) s ON s.board = i.board WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.id) AND (stop IS NULL OR page < stop) AND date >= '2023-01-01'")
def _(spark, sf):
    d = T(spark, sf, "documents")
    date = F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), (2000 - F.col("doc_id") % 2000).cast("int")), "yyyy-MM-dd")
    items = d.select(F.col("source").alias("board"), F.floor(F.col("doc_id") / 20).alias("page"), F.col("doc_id").alias("id"), date.alias("date"))
    known = items.join(T(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("board", "id")
    return files.crawl(items, known, "2023-01-01").select("board", "page", "id", "date")


# sinks


@R.add("b01_saved_in_order", f"SELECT {_ID}, value FROM observation", OBS)
def _(spark, sf):
    path = fresh_dir(spark, "sorted")
    tables.save_sorted(_ids(views.observations(spark, sf)).select("id", "value"), path, ["id"])
    return spark.read.schema("id string, value double").json(path)


@R.add("b02_saved_in_shards", "SELECT doc_id, lang, source FROM documents")
def _(spark, sf):
    path = fresh_dir(spark, "shards")
    tables.save_shards(T(spark, sf, "documents").select("doc_id", "lang", "source", "text"), path, "lang", ["text"])
    return spark.read.schema("doc_id long, source string, lang string").parquet(path)


@R.add("b03_versions_upserted", "SELECT action, count(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS action FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'added' FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 3 <> 0) GROUP BY 1")
def _(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("value"), F.lit("2024-01").alias("released"), "o_custkey", "o_orderkey")
    versions = tables.Versions(spark, fresh_dir(spark, "versions"))
    versions.write(o.where("o_custkey % 2 = 0").select("id", "value", "released"))
    changed = F.when(F.col("o_orderkey") % 3 == 2, F.col("value") + 1).otherwise(F.col("value"))
    counts = versions.upsert(o.where("o_orderkey % 3 <> 0").select("id", changed.alias("value"), "released"), "id", "released", ["value"])
    return spark.createDataFrame(list(counts.items()), "action string, rows long")


@R.add("b09_run_stamp", "SELECT count(*) AS rows, 'video' AS lacking, false AS ok FROM events")
def _(spark, sf):
    counts = T(spark, sf, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count("*").alias("n"))
    return tables.run_stamp(counts, ["click", "video"], True)


@R.add("b11_projected", "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS org, CAST(n_chars AS INT) AS pages, CAST(NULL AS VARCHAR) AS file_url FROM documents")
def _(spark, sf):
    rows = T(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("org"), F.col("n_chars").alias("pages"), F.lit(1).alias("other"))
    return schemas.project(rows, "report").select("id", "org", "pages", "file_url")


# states of runs, and printed text


@R.add("c21_unregistered", "SELECT 'http://b/' || c_nationkey AS url FROM customer WHERE c_nationkey >= 10 GROUP BY c_nationkey")
def _(spark, sf):
    menu = T(spark, sf, "customer").select(F.concat(F.lit("http://b/"), "c_nationkey").alias("url"), F.col("c_custkey").alias("k"))
    known = T(spark, sf, "nation").where("n_nationkey < 10").select(F.concat(F.lit("HTTP://B/"), "n_nationkey", F.lit("/?page=1")).alias("url"))
    return status.unregistered(menu, known, "url", "k")


@R.add("i12_preferred_attachment", "SELECT l_orderkey, 'doc' AS kind, arg_min(l_partkey || e, (CASE e WHEN '.hwpx' THEN 1 ELSE 2 END, l_partkey || e)) AS url FROM (SELECT l_orderkey, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN '.hwpx' WHEN 1 THEN '.pdf' ELSE '.zip' END AS e FROM lineitem) WHERE e <> '.zip' GROUP BY 1")
def _(spark, sf):
    ext = F.when(F.col("l_linenumber") % 3 == 0, ".hwpx").when(F.col("l_linenumber") % 3 == 1, ".pdf").otherwise(".zip")
    rows = T(spark, sf, "lineitem").select("l_orderkey", F.lit("doc").alias("kind"), F.concat("l_partkey", ext).alias("url"))
    return status.preferred(rows, ["l_orderkey"], ["hwpx", "pdf"])


@R.add("e21_needs_summary", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders ORDER BY m DESC LIMIT 5) AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    posts = T(spark, sf, "orders").select("o_orderkey", month_of(F.col("o_orderdate")).alias("month"), F.when(F.col("o_orderstatus") != "O", "said").alias("summary"), (F.col("o_orderpriority") == "1-URGENT").alias("has_document"))
    return status.needs_summary(posts, 5).select("o_orderkey")


@R.add("i11_unhealthy_first", "SELECT n_name AS domain, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey * 10 END AS rows, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey % 4 * 20 END AS hours, n_nationkey % 4 = 3 AS malformed FROM nation")
def _(spark, sf):
    n = T(spark, sf, "nation")
    at = F.date_format(F.to_timestamp(F.lit("2024-01-05 00:00:00")) - F.make_interval(hours=F.col("n_nationkey") % 4 * 20), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.when(F.col("n_nationkey") % 4 == 3, "{").otherwise(F.to_json(F.struct(at.alias("run_at"), (F.col("n_nationkey") * 10).alias("rows"))))
    found = status.indicators(n.select(F.col("n_name").alias("domain"), body.alias("body")), F.to_timestamp(F.lit("2024-01-05 00:00:00")))
    return found.select("domain", "rows", "hours", "malformed")


@R.add("h20_due_hours", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [8, 9, 13, 17, 21] ELSE [20, 21] END AS hours FROM orders")
def _(spark, sf):
    hours = F.when(F.col("o_orderkey") % 2 == 0, status.due_hours(F.col("o_orderdate"), 8, 4)).otherwise(status.due_hours(F.col("o_orderdate"), 20, 4))
    return T(spark, sf, "orders").select("o_orderkey", hours.alias("hours"))


@R.add("h26_elapsed_hours", "SELECT event_id, CAST(greatest(floor((epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(date_trunc('second', ts))) / 3600), 0) AS BIGINT) AS hours FROM events")
def _(spark, sf):
    return T(spark, sf, "events").select("event_id", visits.elapsed_hours(F.col("ts"), F.to_timestamp(F.lit("2024-01-15 12:00:00"))).alias("hours"))


@R.add("k08_compatible_forms", "SELECT p_partkey, 'A1 ' || p_name AS name FROM part")
def _(spark, sf):
    return T(spark, sf, "part").select("p_partkey", printed.nfkc(F.concat(F.lit("Ａ１　"), "p_name")).alias("name"))


@R.add("k17_topic_particles", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '전망은' WHEN 1 THEN '조사는' ELSE n_name || '는' END AS said FROM nation")
def _(spark, sf):
    k = F.col("n_nationkey") % 3
    word = F.when(k == 0, "전망").when(k == 1, "조사").otherwise(F.col("n_name"))
    return T(spark, sf, "nation").select("n_nationkey", F.concat(word, printed.topic_particle(word)).alias("said"))


@R.add("k20_tags", "SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'a') THEN 'has a' END, CASE WHEN contains(replace(p_name, 'part', ' '), '1') THEN 'one' END) AS tags FROM part")
def _(spark, sf):
    return T(spark, sf, "part").select("p_partkey", F.array_join(printed.tags_of(F.concat(F.lit("XaX "), F.replace("p_name", F.lit("a"), F.lit("A"))), {"has a": ["A"], "one": ["1"]}, ["xax"]), ",").alias("tags"))


@R.add("k27_unbolded", "SELECT c_custkey, 'Text 1,000 of ' || c_custkey AS line FROM customer")
def _(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, printed.unbolded(F.regexp_replace(F.concat(F.lit("Text 1,000 of "), "c_custkey"), r"(\S)", "$1$1$1"))).otherwise(printed.unbolded(F.concat(F.lit("Text 1,000 of "), "c_custkey"))).alias("line"))


@R.add("k54_schedule_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(spark, sf):
    o = T(spark, sf, "orders")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M.d (E)")).otherwise(F.concat(F.month("o_orderdate"), F.lit("월 "), F.dayofmonth("o_orderdate"), F.lit("일")))
    return o.select("o_orderkey", printed.schedule_date(said, F.year("o_orderdate")).alias("day"))


# office files: written from tables, a file for each nation, and read as a data source

_SHEET = "CASE WHEN s_acctbal < 0 THEN 'due' ELSE 'held' END"
_PLACED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey, {_SHEET} ORDER BY s_suppkey) AS INT) AS r, {_SHEET} AS sheet FROM supplier)"


def _books(spark, sf, make, suffix: str) -> str:
    path = fresh_dir(spark, "office")
    sheet = F.when(F.col("s_acctbal") < 0, "due").otherwise("held")
    s = T(spark, sf, "supplier").withColumn("sheet", sheet)
    s = s.withColumn("r", F.row_number().over(W.partitionBy("s_nationkey", "sheet").orderBy("s_suppkey")))
    cells = s.select(F.concat(F.lit("n"), "s_nationkey").alias("file"), "sheet", F.when(F.col("sheet") == "due", 2).otherwise(10).alias("section"), F.col("r").alias("row"), F.posexplode(F.array(F.concat(F.lit("k<"), "s_suppkey"), "s_name", F.lit(""), "s_name")).alias("col", "value"))
    heads = cells.select("file", "sheet", "section").distinct().select("*", F.lit(0).alias("row"), F.lit(0).alias("col"), F.concat(F.lit("part "), "sheet").alias("value"))
    rows = cells.where("value <> ''") if suffix == ".xlsx" else cells.unionByName(heads)
    office_sink.write_files(rows, "file", path, make, suffix).write.format("noop").mode("overwrite").save()
    office_source.register(spark)
    return path


def _file() -> Column:
    return F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("file")


@R.add("a09_sheet_cells", f"SELECT 'n' || s_nationkey AS file, r AS \"row\", unnest([0, 1, 3]) AS col, unnest(['k<' || s_suppkey, s_name, s_name]) AS value FROM {_PLACED} WHERE sheet = 'due'")
def _(spark, sf):
    """One sheet of each workbook; the others aren't opened."""
    cells = spark.read.format("office").load(_books(spark, sf, office_sink.workbook, ".xlsx"))
    return cells.where("sheet = 'due'").select(_file(), "row", "col", "value")


@R.add("a11_document_tables", f"SELECT 'n' || s_nationkey AS file, CASE sheet WHEN 'due' THEN 2 ELSE 10 END AS section, r - 1 AS \"row\", unnest([0, 1, 2, 3]) AS col, unnest(['k<' || s_suppkey, s_name, '', s_name]) AS value FROM {_PLACED}")
def _(spark, sf):
    cells = spark.read.format("office").option("kind", "tables").load(_books(spark, sf, office_sink.document, ".hwpx"))
    return cells.select(_file(), "section", "row", "col", "value")


@R.add("a12_document_paragraphs", f"""SELECT file, section, CAST(row_number() OVER (PARTITION BY file, section ORDER BY r, col) - 1 AS INT) AS k, value AS text FROM (
    SELECT 'n' || s_nationkey AS file, CASE sheet WHEN 'due' THEN 2 ELSE 10 END AS section, r, unnest([0, 1, 3]) AS col, unnest(['k<' || s_suppkey, s_name, s_name]) AS value FROM {_PLACED}
    UNION ALL SELECT DISTINCT 'n' || s_nationkey, CASE sheet WHEN 'due' THEN 2 ELSE 10 END, 0, 0, 'part ' || sheet FROM {_PLACED})""")
def _(spark, sf):
    rows = spark.read.format("office").option("kind", "paragraphs").load(_books(spark, sf, office_sink.document, ".hwpx"))
    return rows.select(_file(), "section", "k", "text")


_DOMAINS = ("employment", "forecast", "press", "ask", "reports")
_MB = "printf('%.2fMB', {} / 1048576.0)"
_LATE = "CASE WHEN k % 2 = 0 THEN '30시간째 안 돌았다' END"
_BAD_A, _BAD_B, _HELD_B = "k % 3 = 0", "k % 4 = 0 AND k % 8 <> 0", "k % 8 = 0"
_STATES = f"""SELECT k, domain, CASE WHEN k % 13 = 0 THEN '불러오지 못함' WHEN k % 11 = 0 THEN '형식을 못 읽음' END AS reason, f, w FROM (
    SELECT k, domain, concat_ws(';', '수집기 실패=' || (CAST({_BAD_A} AS INT) + CAST({_BAD_B} AS INT)), '오류=' || CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END) AS f, concat_ws(';', {_LATE}, CASE WHEN {_BAD_A} OR {_BAD_B} THEN '수집기 실패: ' || concat_ws(', ', CASE WHEN {_BAD_A} THEN 'a' END, CASE WHEN {_BAD_B} THEN 'b' END) END, CASE WHEN {_HELD_B} THEN '봇 차단 중: b' END, CASE WHEN k % 7 = 0 THEN '충돌 1건' END) AS w FROM made WHERE k % 5 < 2
    UNION ALL SELECT k, domain, concat_ws(';', '회차=' || k, CASE WHEN k % 9 <> 0 THEN '미판정=' || k % 4 END), concat_ws(';', {_LATE}, CASE WHEN k % 9 <> 0 AND k % 4 > 0 THEN '판정 없는 기사 ' || k % 4 || '건 — 구독 판정이 막혔는지 보라' END) FROM made WHERE k % 5 = 2
    UNION ALL SELECT k, domain, CASE WHEN k % 3 = 0 THEN '카탈로그=정상' ELSE '카탈로그=실패' END, concat_ws(';', {_LATE}, CASE WHEN k % 3 <> 0 THEN '카탈로그 갱신 실패' END) FROM made WHERE k % 5 = 3
    UNION ALL SELECT k, domain, concat_ws(';', '게시판 실패=' || CAST({_BAD_A} AS INT), '전체 보고서=' || k, '초록 gzip=' || {_MB.format('k * 100000')}, CASE WHEN k % 2 = 0 THEN '최대 조각=en ' || {_MB.format('k * 50000')} END, CASE WHEN k % 6 = 0 THEN '미판정=판정 기록 없음' ELSE '미판정=' || k % 3 END),
        concat_ws(';', {_LATE}, CASE WHEN {_BAD_A} THEN '게시판 실패: b1' END, CASE WHEN k % 4 = 0 THEN '미등록 게시판 1건' END, CASE WHEN k % 2 = 0 AND k * 50000 > 3145728 THEN '초록 조각 en ' || {_MB.format('k * 50000')} || ' — 또 쪼갤 때다' END, CASE WHEN k % 2 = 1 AND k * 100000 > 3145728 THEN '초록 gzip ' || {_MB.format('k * 100000')} || ' — 기관별로 쪼갤 때다' END, CASE WHEN k % 6 = 0 THEN '판정 기록 없음' WHEN k % 3 > 0 THEN '미판정 ' || k % 3 || '건' END) FROM made WHERE k % 5 = 4)"""


@R.add("m19_domain_states", f"SELECT k, domain, reason, CASE WHEN reason IS NULL THEN f END AS figures, CASE WHEN reason IS NULL THEN w END AS warnings FROM (WITH made AS (SELECT s_suppkey AS k, [{', '.join(repr(d) for d in _DOMAINS)}][s_suppkey % 5 + 1] AS domain FROM supplier) {_STATES})")
def _(spark, sf):
    k = F.col("k")
    ok = lambda bad, **more: F.struct((~bad).alias("ok"), *(v.alias(n) for n, v in more.items()))
    some = lambda when, *values: F.when(when, F.array(*map(F.lit, values))).otherwise(F.expr("CAST(array() AS array<string>)"))
    ran = F.when(k % 2 == 0, "2024-01-02T00:00:00Z").otherwise("2024-01-03T00:00:00Z")
    collectors = F.struct(ran.alias("run_at"), F.struct(ok(k % 3 == 0).alias("a"), ok(k % 4 == 0, blocked=k % 8 == 0).alias("b")).alias("collectors"), some(k % 7 == 0, "x").alias("conflicts"), some(k % 6 == 0, "e", "f").alias("errors"))
    press_ = F.struct(ran.alias("run_at"), k.alias("rounds"), F.when(k % 9 != 0, k % 4).alias("unjudged"))
    reports = F.struct(
        ran.alias("at"), F.struct(ok(k % 3 == 0).alias("b1")).alias("boards"), k.alias("reports"), some(k % 4 == 0, "u").alias("unregistered"),
        F.struct((k * 100_000).alias("abstracts_gzip"), F.when(k % 2 == 0, F.struct((k * 50_000).alias("en"))).alias("abstracts_shards_gzip")).alias("sizes"), F.when(k % 6 != 0, F.struct((k - k % 3).alias("judged"))).alias("recommend"),
    )
    body = F.when(k % 5 < 2, F.to_json(collectors)).when(k % 5 == 2, F.to_json(press_)).when(k % 5 == 3, F.to_json(F.struct(ran.alias("run_at"), F.struct((k % 3 == 0).alias("ok")).alias("catalog")))).otherwise(F.to_json(reports))
    body = F.when(k % 13 == 0, None).when(k % 11 == 0, '{"x": 1}').otherwise(body)
    rows = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).select("k", views.pick(_DOMAINS, k % 5).alias("domain"), body.alias("body"))
    made = status.domain_states(rows, F.to_timestamp(F.lit("2024-01-03 06:00:00")))
    return made.select("k", "domain", "reason", F.array_join(F.transform("figures", lambda x: F.concat_ws("=", x["label"], x["value"])), ";").alias("figures"), F.array_join("warnings", ";").alias("warnings"))
