"""Readers of JSON, CSV and XML files. A path without files is an empty table, not an error."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import require
from .schemas import TABLES, project


def _or_empty(spark: SparkSession, load, schema: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path, table: str, recursive: bool = False) -> DataFrame:
    """JSON arrays of records, by the table's schema; `path` is one or several files, folders or globs."""
    reader = spark.read.schema(TABLES[table]).option("multiLine", True).option("recursiveFileLookup", recursive)
    return _or_empty(spark, lambda: reader.json(path), TABLES[table])


def read_unique(spark: SparkSession, path, table: str, key: str = "id") -> DataFrame:
    """read_table, with an error that lists keys that occur twice."""
    df = read_table(spark, path, table)
    require(df.groupBy(key).count().where("count > 1").orderBy(key), f"{table} has repeated keys")
    return df


def read_overrides(spark: SparkSession, folder: str, table: str, key: str = "id") -> DataFrame:
    """Manual records of several files; of one key, the record of the file whose name comes last."""
    df = spark.read.schema(TABLES[table]).option("multiLine", True).json(folder).withColumn("_file", F.col("_metadata.file_name"))
    columns = [c for c in df.columns if c != "_file"]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), "_file").alias("r")).select("r.*")


def read_shards(spark: SparkSession, glob: str) -> DataFrame:
    """Maps id -> text in several files as rows (id, text); of one id, the text of the file whose name comes last."""
    whole = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.from_json("value", "map<string,string>").alias("m"))
    return whole.select("f", F.explode("m").alias("id", "text")).groupBy("id").agg(F.max_by("text", "f").alias("text"))


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """{source: {month: {...}}} as rows; the id is source-month, missing attachments are none."""
    release = "struct<title:string,posted_at:date,url:string,attachments:array<struct<type:string,url:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,map<string,{release}>>")).alias("source", "months"))
    flat = rows.select("source", F.explode("months").alias("month", "r")).select("source", "month", "r.*")
    none = F.expr("CAST(array() AS array<struct<type:string,url:string>>)")
    return project(flat.withColumns({"id": F.concat_ws("-", "source", "month"), "attachments": F.coalesce("attachments", none)}), "release")


def rounds_on_disk(spark: SparkSession, folder: str, pattern: str = r"(\d{4}-\d{2}-\d{2})-([a-z]+)\.json$") -> DataFrame:
    """The (release, kinds) that file names tell of; no content is read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = names.select(F.regexp_extract("path", pattern, 1).alias("release"), F.regexp_extract("path", pattern, 2).alias("kind")).where("release <> ''")
    return found.groupBy("release").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def read_sdmx_csv(spark: SparkSession, path, area: str = "KOR") -> DataFrame:
    """Annual observations of an area: (measure, year, value); cells without a figure are left out."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = df.where((F.col("REF_AREA") == area) & (F.col("FREQ") == "A") & (F.trim(F.coalesce("OBS_VALUE", F.lit(""))) != ""))
    return rows.select(F.col("MEASURE").alias("measure"), F.col("TIME_PERIOD").cast("int").alias("year"), F.col("OBS_VALUE").cast("double").alias("value"))


def read_sdmx_json(spark: SparkSession, path) -> DataFrame:
    """SDMX-JSON with positional observations: (series, period, value). An observation's key is its place in the
    list of periods."""
    obs = "map<string,array<string>>"
    schema = f"struct<data:struct<structures:array<struct<dimensions:struct<observation:array<struct<values:array<struct<value:string,id:string>>>>>>>,dataSets:array<struct<series:map<string,struct<observations:{obs}>>>>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.data.*")
    d = d.select(F.col("structures")[0]["dimensions"]["observation"][0]["values"].alias("periods"), F.explode(F.col("dataSets")[0]["series"]).alias("series", "s"))
    rows = d.select("periods", "series", F.explode("s.observations").alias("k", "v"))
    at = F.get("periods", F.col("k").cast("int"))
    return rows.select("series", F.coalesce(at["value"], at["id"]).alias("period"), F.col("v")[0].cast("double").alias("value")).where("value is not null")


def read_sdmx_xml(spark: SparkSession, path) -> DataFrame:
    """Observations of an SDMX-ML file: (period, value), from the attributes of its Obs elements."""
    obs = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(<(?:\w+:)?Obs\b[^>]*>)"), F.lit(1))).alias("o"))
    attribute = lambda a: F.regexp_extract("o", rf'\b{a}="([^"]*)"', 1)
    return obs.select(attribute("TIME_PERIOD").alias("period"), F.when(attribute("OBS_VALUE") != "", attribute("OBS_VALUE")).cast("double").alias("value"))


def vintages_of_wide(df: DataFrame, keys: list[str], pattern: str = r"^[SF](\d{4})$") -> DataFrame:
    """A column per vintage (S2025: spring, F2025: autumn) as rows (keys, vintage, value); "." and blanks are null."""
    import re

    wide = [c for c in df.columns if re.match(pattern, c)]
    long = df.select(*keys, *(F.col(c).cast("string").alias(c) for c in wide)).unpivot(keys, wide, "vintage", "value")
    return long.withColumn("value", F.when(~F.trim("value").isin(".", ""), F.col("value")).cast("double"))


def read_rss(spark: SparkSession, path, title: str = ".*") -> DataFrame:
    """Items of a feed whose title matches: (title, date, url)."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("i"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1), r"(?s)^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    found = items.select(tag("title").alias("title"), tag("pubDate").alias("date"), tag("link").alias("url"))
    return found.where(F.col("title").rlike(title))


def list_rows(pages: DataFrame, html: str, keyword: str) -> DataFrame:
    """Rows of HTML lists (tr or li) that hold a keyword: title without tags, first date, first link."""
    from ..functions.text import plain

    rows = pages.withColumn("_row", F.explode(F.split(F.col(html), r"(?i)(?=<(?:tr|li)\b)"))).where(F.col("_row").rlike(r"(?i)^<(?:tr|li)\b"))
    made = rows.withColumns({"title": plain(F.col("_row")), "date": F.regexp_replace(F.regexp_extract("_row", r"(\d{4}[-./]\d{1,2}[-./]\d{1,2})", 1), "[./]", "-"), "link": F.regexp_extract("_row", r"""(?i)href\s*=\s*["']?([^"'>\s]+)""", 1)})
    return made.where(F.col("title").contains(keyword)).drop("_row")


def first_per_period(posts: DataFrame, order: str) -> DataFrame:
    """Of a paged list's posts (source, period), the first of each period."""
    columns = posts.columns
    return posts.groupBy("source", "period").agg(F.min_by(F.struct(*columns), order).alias("r")).select("r.*")


def read_boards(pages: DataFrame, posts: DataFrame, strict: bool = False) -> DataFrame:
    """Fetched list pages (source, page, html, null where it couldn't be read) and the posts found on them (source,
    page, place, period, ...) as the first post of each period, of the pages before the first page - not the
    source's first one - that was read and lists none. A page that couldn't be read is no empty page: the pages
    behind it count, and strictly it is an error."""
    if strict:
        require(pages.where("html is null").select("source", "page").orderBy("source", "page"), "boards that couldn't be read")
    found = posts.groupBy("source", "page").agg(F.count("*").alias("_n"))
    empty = pages.where("html is not null and page > 1").join(found, ["source", "page"], "left_anti")
    stop = empty.groupBy("source").agg(F.min("page").alias("_stop"))
    readable = pages.where("html is not null").select("source", "page").distinct()
    own = posts.join(readable, ["source", "page"], "left_semi").join(stop, "source", "left").where("_stop is null or page < _stop").drop("_stop")
    return first_per_period(own.withColumn("_o", F.struct("page", "place")), "_o").drop("_o")


def crawl(items: DataFrame, known: DataFrame, cutoff: str) -> DataFrame:
    """Of a board's listed items (board, page, id, date) those an incremental crawl takes: unseen ones not older
    than the cutoff, from the pages before the first page without any unseen item."""
    marked = items.join(known.select("board", "id", F.lit(True).alias("_known")), ["board", "id"], "left")
    pages = marked.groupBy("board", "page").agg(F.bool_or(F.col("_known").isNull()).alias("fresh"))
    stop = pages.where("not fresh").groupBy("board").agg(F.min("page").alias("stop"))
    taken = marked.join(stop, "board", "left").where("_known is null and (stop is null or page < stop)")
    return taken.where(F.col("date") >= cutoff).drop("_known", "stop")


def series_of_rows(rows: DataFrame, source: str, divisor: float = 1000.0) -> DataFrame:
    """Statistics-office rows (C1, C2_NM, ITM_ID, PRD_DE yyyyMM, DT text) as observations, counts in thousands to one decimal."""
    from ..functions.numbers import parse_number, round_decimal

    period = F.concat_ws("-", F.substring("PRD_DE", 1, 4), F.substring("PRD_DE", 5, 2))
    return rows.select(F.lit(source).alias("source"), F.col("ITM_ID").alias("series"), F.col("C1").alias("breakdown"), F.col("C2_NM").alias("category"), period.alias("period"), round_decimal(parse_number(F.col("DT")) / divisor, 1).alias("value"))
