"""Line dedup in DataFrame functions only: lines that many documents share stay in one of them.

Texts are exploded into their lines. A line's key is the line stripped of white space, with
A-Z in lower case; keys of at least `min_chars` code points are hashed (128 bits), and the
distinct documents of each hash counted. Lines whose key at least `min_docs` documents hold are
dropped everywhere but in the largest id that holds it; what stays is reassembled by position.

Only hashes and positions are shuffled for the count, first by (hash, document), so a line that
a third of all documents share is counted in as many parts as it has documents; the join that
finds its lines is one that Spark splits. Texts are shuffled once, to meet the positions they
lose, and cut by runs between these, in time linear in their lines. A row is named by its id and
its text's hash, not by a number that a lost executor could deal anew.

Nulls: a null text is one empty line and stays null; rows without an id are one document, which
keeps a shared line only if no document with an id has it. Repeated rows are one document and
stay rows each; rows of one id with different texts are one document too. Very long texts and
lines are handled whole. An empty table gives an empty result. Other columns pass through; those
named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_CHARS, MIN_DOCS = 40, 5
#: Fixed values of the contract: white space and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space around it, A-Z in lower case; texts of ASCII alone take the faster way."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """_hn_doc, _hn_row, _hn_at (from 0), _hn_k1, _hn_k2: the lines that are long enough, without their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("_hn_doc"), F.xxhash64(text_col).alias("_hn_row"), F.posexplode(F.split(text, "\n")).alias("_hn_at", "_hn_line"))
    lines = lines.where(F.length("_hn_line") >= min_chars).withColumn("_hn_key", line_key(F.col("_hn_line"))).where(F.length("_hn_key") >= min_chars)
    return lines.select("_hn_doc", "_hn_row", "_hn_at", F.xxhash64("_hn_key").alias("_hn_k1"), F.xxhash64(F.lit("line"), "_hn_key").alias("_hn_k2"))


def dropped_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """_hn_doc, _hn_row and the sorted positions of the lines that go."""
    keys = ["_hn_k1", "_hn_k2"]
    held = lines.groupBy(*keys).agg((F.count_distinct("_hn_doc") + F.max(F.col("_hn_doc").isNull().cast("int"))).alias("n"), F.max("_hn_doc").alias("_hn_holder"))
    # written, so that the join deals both sides itself and Spark can split the lines of one key
    shared = materialize(held.where(F.col("n") >= min_docs).select(*keys, "_hn_holder"), "shared-lines")
    gone = lines.join(shared, keys).where(~F.col("_hn_doc").eqNullSafe(F.col("_hn_holder")))
    return gone.groupBy("_hn_doc", "_hn_row").agg(F.sort_array(F.collect_set("_hn_at")).alias("_hn_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines that stay as their text, n_lines (before) and n_dropped."""
    lines = materialize(long_lines(docs, id_col, text_col, min_chars), "lines")
    gone = dropped_positions(lines, min_docs).withColumnsRenamed({"_hn_doc": "_hn_gone_doc", "_hn_row": "_hn_gone_row"})
    rows = docs.withColumn("_hn_row", F.xxhash64(text_col))
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("_hn_gone_doc")) & (F.col("_hn_row") == F.col("_hn_gone_row")), "left")
    rows = rows.withColumn("_hn_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    # _hn_lines is read more than once, so Spark splits each text once instead of inside the lambda
    total = F.size("_hn_lines")
    before = F.concat(F.array(F.lit(-1)), F.col("_hn_gone"))
    run = lambda b, i: F.slice("_hn_lines", b + 2, F.coalesce(F.get("_hn_gone", i), total) - b - 1)
    kept = F.when(F.col("_hn_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(F.transform(before, run)), "\n"))
    rows = rows.withColumns({"_hn_kept": kept, "n_lines": total.cast("long"), "n_dropped": F.coalesce(F.size("_hn_gone"), F.lit(0)).cast("long")})
    return rows.withColumn(text_col, F.col("_hn_kept")).select(*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns))
