"""Tables and sections of printed documents, as rows: (doc, page, k, line) or words with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import printed


def grid(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, k, line) of tables as cells (keys, label, column, value). The first line with two years or
    more is the header; a row counts if it has as many figures as the header has columns."""
    years = F.regexp_extract_all("line", F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    headers = lines.withColumn("_y", years).where(F.size("_y") >= 2).groupBy(*keys).agg(F.min("k").alias("_at"), F.min_by("_y", "k").alias("columns"))
    rows = lines.join(headers, keys).where(F.col("k") > F.col("_at")).withColumns({"label": printed.row_label(F.col("line")), "v": printed.row_figures(F.col("line"))})
    cells = rows.where((F.size("v") == F.size("columns")) & (F.col("label") != "")).select(*keys, "k", "label", F.explode(F.arrays_zip("columns", "v")).alias("c"))
    return cells.select(*keys, "k", "label", F.col("c.columns").alias("column"), F.col("c.v").alias("value"))


def placed_words(words: DataFrame, keys: list[str], gap: float = 5.0) -> DataFrame:
    """Words (keys, top, left, text) with their printed row: a word begins a row if it lies more than `gap` below the one before."""
    order = W.partitionBy(*keys).orderBy("top", "left")
    fresh = F.coalesce(F.col("top") - F.lag("top").over(order) > gap, F.lit(True)).cast("int")
    return words.withColumn("_f", fresh).withColumn("row", F.sum("_f").over(order)).drop("_f")


def nearest_columns(words: DataFrame, headers: DataFrame, keys: list[str], reach: float = 30.0) -> DataFrame:
    """Figures of rows under the nearest header (keys, column, at) within `reach`: (keys, row, column, value)."""
    figures = words.withColumn("value", F.get(printed.row_figures(F.col("text")), F.lit(0))).where("value is not null")
    near = figures.join(headers, keys).withColumn("d", F.abs(F.col("left") - F.col("at"))).where(F.col("d") <= reach)  # headers are a page's columns
    return near.groupBy(*keys, "row", "column").agg(F.min_by("value", F.struct("d", "left")).alias("value"))


def sections(lines: DataFrame, keys: list[str], names: list[str], ends: list[str]) -> DataFrame:
    """Lines with the section they stand in: a section lasts until another begins or an ending label comes."""
    begins = F.coalesce(*[F.when(F.col("line").contains(n), F.lit(n)) for n in names])
    ended = F.lit(False)
    for e in ends:
        ended = ended | F.col("line").contains(e)
    mark = F.when(begins.isNotNull(), begins).when(ended, F.lit(""))
    order = W.partitionBy(*keys).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.nullif(F.last(mark, ignorenulls=True).over(order), F.lit("")))


def summary_lines(lines: DataFrame, keys: list[str], start: Column, stop: Column, most: int = 8) -> DataFrame:
    """The first `most` bulleted lines between the first starting line and the next stopping one."""
    first = lines.where(start).groupBy(*keys).agg(F.min("k").alias("_a"))
    inside = lines.join(first, keys).where(F.col("k") > F.col("_a"))
    last = inside.where(stop).groupBy(*keys).agg(F.min("k").alias("_b"))
    bullets = inside.join(last, keys, "left").where((F.col("_b").isNull() | (F.col("k") < F.col("_b"))) & F.col("line").rlike(r"^\s*[-○●◦□■*·]"))
    order = W.partitionBy(*keys).orderBy("k")
    return bullets.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*keys, "place", F.trim(F.regexp_replace("line", r"^\s*[-○●◦□■*·]+\s*", "")).alias("line"))


def abstracts(pages: DataFrame, keys: list[str], start: Column, body: Column) -> DataFrame:
    """Text from the first page that `start` marks to the page before the next that `body` marks: words cut at
    line ends are joined, running headers (a first line that three pages or more share) go."""
    first = pages.where(start).groupBy(*keys).agg(F.min("page").alias("_a"))
    after = pages.join(first, keys)
    end = after.where(body & (F.col("page") > F.col("_a"))).groupBy(*keys).agg(F.min("page").alias("_b"))
    own = after.join(end, keys, "left").where((F.col("page") >= F.col("_a")) & (F.col("_b").isNull() | (F.col("page") < F.col("_b"))))
    head = F.get(F.split("text", "\n"), F.lit(0))
    running = pages.groupBy(*keys, head.alias("_h")).agg(F.count("*").alias("_n")).where("_n >= 3").drop("_n")
    kept = own.withColumn("_h", head).join(running.withColumn("_run", F.lit(True)), [*keys, "_h"], "left")
    text = F.when(F.col("_run"), F.expr("substring(text, length(_h) + 2)")).otherwise(F.col("text"))
    made = kept.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", text.alias("t")))), lambda p: p["t"]), "\n").alias("t"))
    return made.select(*keys, F.regexp_replace("t", r"(\p{L})-\n(\p{Ll})", "$1$2").alias("abstract"))


def country_pages(pages: DataFrame, keys: list[str], country: str, more: int = 4) -> DataFrame:
    """The first page that has the country alone among its first three lines, and those of the next `more` that name it."""
    alone = F.exists(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.trim(x) == country)
    first = pages.where(alone).groupBy(*keys).agg(F.min("page").alias("_a"))
    return pages.join(first, keys).where((F.col("page") == F.col("_a")) | F.col("page").between(F.col("_a") + 1, F.col("_a") + more) & F.col("text").contains(country)).drop("_a")


def first_readable(pages: DataFrame, keys: list[str], columns: Column, figures: Column, published_year: Column) -> DataFrame:
    """Of each document the first page whose columns hold a year from publication on and that has figures."""
    ok = F.exists(columns, lambda y: y.cast("int") >= published_year) & (F.size(figures) > 0)
    return pages.where(ok).groupBy(*keys).agg(F.min("page").alias("page"))


def overlapping_labels(labels: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Labels printed as pictures (top, bottom) beside the text line whose middle lies within them."""
    inside = (F.col("middle") >= F.col("top")) & (F.col("middle") <= F.col("bottom"))
    return labels.join(lines, keys).where(inside)


def quoted_on_page(quotes: DataFrame, pages: DataFrame, keys: list[str], quote: str = "quote", hint: str = "hint") -> DataFrame:
    """Quotes with the page that says them word for word: the one hinted at if it does, else the first; null if none does."""
    said = quotes.select(*keys, quote, hint).distinct().join(pages.select(*keys, "page", "text"), keys).where(printed.quoted(F.col(quote), F.col("text")))
    found = said.groupBy(*keys, quote, hint).agg(F.min_by("page", F.struct(~F.col("page").eqNullSafe(F.col(hint)), "page")).alias("page"))
    found = found.select(*(F.col(c).alias(f"_{c}") for c in (*keys, quote, hint)), "page")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, quote, hint)]
    return quotes.join(found, on, "left").select(*quotes.columns, "page")


#: The folded header's year, its mark of a revision, and words of its row of periods.
FOLD_YEAR, FOLD_MARK, FOLD_PERIODS = r"(?:19|20)\d{2}", r"수정폭(?:\d*\))?", "연간|상반|하반"


def unfolded_header(text: Column) -> Column:
    """A header of four lines - a year alone, years, the mark of the revision, periods - as two: the years with
    their last one again, and the periods with the mark in their last place. Any other text stays as it is."""
    gap, line = "[ \t]*", "[ \t]+"
    shape = (
        rf"(?s)\A((?:[^\n]*\n)*?){gap}{FOLD_YEAR}{gap}\n{gap}({FOLD_YEAR}(?:{line}{FOLD_YEAR})*{line}({FOLD_YEAR})){gap}\n"
        rf"{gap}({FOLD_MARK}){gap}\n(?=[^\n]*(?:{FOLD_PERIODS})){gap}([^\s]+(?:{line}[^\s]+)*?){line}[^\s]+{gap}(\n.*|\z)"
    )
    return F.regexp_replace(text, shape, "$1$2 $3\n$5 $4$6")
