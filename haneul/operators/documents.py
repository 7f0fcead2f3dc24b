"""A document archive: rows (doc_id, org, board, title, body, published)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def on_boards(df: DataFrame, boards: DataFrame) -> DataFrame:
    """Rows on boards that are registered and enabled, with the boards' flags; boards are a small dimension."""
    return df.join(boards.where("enabled").drop("enabled"), "board")


def one_per_title(df: DataFrame, flagged: Column) -> DataFrame:
    """On flagged boards one row per (board, title) stays, the first by (published, doc_id); other rows pass."""
    keys = df.where(flagged).groupBy("board", "title").agg(F.min(F.struct("published", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("_keep"))
    return df.join(keys, df["doc_id"] == keys["_keep"], "left").where(~flagged | F.col("_keep").isNotNull()).drop("_keep")


def first_by_title(df: DataFrame, ordinal: str) -> DataFrame:
    """One row for each title without white space: the first. Combined before the shuffle."""
    columns = df.columns
    made = df.withColumn("_t", text.squash(F.col("title"))).groupBy("_t").agg(F.min_by(F.struct(*columns), ordinal).alias("r"))
    return made.select("r.*")


def missing_rates(df: DataFrame, keys: list[str], missing: Column) -> DataFrame:
    made = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(missing).alias("missing"))
    return made.withColumn("rate", F.round(F.col("missing") / F.col("total"), 3))


def reasons(df: DataFrame, reason: Column) -> DataFrame:
    return df.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def chips(df: DataFrame, column: str) -> DataFrame:
    """How often each element of an array column occurs."""
    return df.select(F.explode(column).alias("topic")).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic")


def shelf(df: DataFrame) -> DataFrame:
    """Per organisation its number of rows, and per board, the largest first."""
    boards = df.groupBy("org", "board").agg(F.count("*").alias("n"))
    return boards.groupBy("org").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "board"))).alias("boards"))


def collapse(df: DataFrame, collapsible: Column, most: int) -> DataFrame:
    """(month, org, board) with more than `most` rows on collapsible boards become one folded row; the others stay rows."""
    month = F.substring("published", 1, 7)
    sizes = df.where(collapsible).groupBy(month.alias("month"), "org", "board").agg(F.count("*").alias("n"), F.max_by("title", F.struct("published", "doc_id")).alias("title")).where(F.col("n") > most)
    folded = sizes.select("month", "org", "board", "title", "n")
    rows = df.withColumn("month", month).join(sizes.select("month", "org", "board"), ["month", "org", "board"], "left_anti")
    return folded.unionByName(rows.select("month", "org", "board", "title", F.lit(1).cast("long").alias("n")))


def weighted_search(df: DataFrame, asked: str, title: int = 100, author: int = 50, body: int = 10) -> DataFrame:
    """Rows that hold the asked text, without white space, in title, authors or body: score, where, and the sentence."""
    q = asked.replace(" ", "")
    has = lambda c: text.squash(F.coalesce(c, F.lit(""))).contains(q)
    in_title, in_author, in_body = has(F.col("title")), F.exists("authors", has), has(F.col("body"))
    n = F.when(in_title, title).otherwise(0) + F.when(in_author, author).otherwise(0) + F.when(in_body, body).otherwise(0)
    where = F.when(in_title, "title").when(in_author, "author").otherwise("body")
    found = df.withColumn("score", n).where(F.col("score") > 0)
    return found.withColumns({"hit": where, "sentence": F.when(in_body, text.sentence_with(F.col("body"), asked))}).orderBy(F.desc("score"), F.desc("published"), "doc_id")


def needs_text(df: DataFrame) -> DataFrame:
    """Rows whose abstract hasn't been tried yet although there is a file."""
    return df.where("not coalesce(tried, false) and body is null and file is not null")


def chunked(df: DataFrame, keys: list[str], body: str = "body", limit: int = 2000) -> DataFrame:
    """A row per piece of a body, numbered; a body without text is no piece."""
    return df.select(*keys, F.posexplode(text.chunks(text.plain(F.coalesce(F.col(body), F.lit(""))), limit)).alias("k", "piece"))


def default_order(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Newest first, of equal dates the greatest id first."""
    return df.orderBy(F.desc("published"), F.desc(key))
