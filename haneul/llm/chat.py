"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with `>` marks are quotes; the number of marks is their level, and
consecutive lines of one level are a passage. A passage's normal form (lower case, letters
and digits, single spaces) is hashed and joined, within its conversation, to the first
message that said it: as its whole text without quotes, as a paragraph or as a line. A
trimmed passage, which no message said so, is linked by its lines to the earlier message that
said the most of them, more than half at least, as lines or in paragraphs; of several to the
latest. A message replies to the latest earlier message that its least nested linked passages quote;
without a link, to the turn before it. Conversations are built in reply order - sorted by
(turn replied to, turn), which puts every message after the one it answers - without quotes.

Messages are sorted in ranges of (conversation, turn replied to, turn, role, message), so one
conversation, and all replies to one post, may spread over many tasks. A place is the one in its
range plus the conversation's counts in the ranges before (a row per range). Texts are gathered
in parts of at most PART messages, so no conversation's length meets in one task.

Nulls: a null text is empty; a null role is "unknown"; a null turn comes last and is linked
to nothing; messages without a conversation id form one conversation without links. Repeated
rows are messages each; messages of one turn come by role and text. A message of quotes alone
has empty content. Very long messages are read whole, in time that grows with their lines. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

PART = 256
#: A quoted line, and the chat format's marks.
QUOTED = r"^\s*>"
OPEN, CLOSE = "<|%s|>\n", "<|end|>\n"
_LAST = (1 << 62) - 1


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def unquoted(text: Column) -> Column:
    """The text without its quoted lines, trimmed."""
    return F.trim(F.regexp_replace(F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(QUOTED)), "\n"), r"^\s+|\s+$", ""))


def quoted_passages(quoting: DataFrame) -> DataFrame:
    """conv_id, turn, message, k, level, text: a row per passage, the consecutive quoted lines of one level, marks removed."""
    marks = lambda x: F.regexp_extract(x, r"^(\s*(?:>\s?)*)", 1)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    line = lambda x, i: F.struct(i.alias("i"), level(x).alias("level"), F.regexp_replace(x, r"^\s*(?:>\s?)*", "").alias("text"))
    cut = quoting.select("conv_id", "turn", "message", F.filter(F.transform(_lines(F.col("text")), line), lambda x: x["level"] > 0).alias("lines"))
    last = lambda k: F.get(F.col("lines"), k - 1)
    begins = F.transform("lines", lambda x, k: F.when((k > 0) & (last(k)["i"] == x["i"] - 1) & (last(k)["level"] == x["level"]), F.lit(-1)).otherwise(k))
    cut = cut.withColumn("begins", F.filter(begins, lambda k: k >= 0))
    size = lambda b, j: F.coalesce(F.get(F.col("begins"), j + 1), F.size("lines")) - b
    parts = F.transform("begins", lambda b, j: F.struct(F.get(F.col("lines"), b)["level"].alias("level"), F.array_join(F.slice("lines", b + 1, size(b, j))["text"], "\n").alias("text")))
    return cut.select("conv_id", "turn", "message", F.posexplode(parts).alias("k", "p")).select("conv_id", "turn", "message", "k", "p.level", "p.text")


def link_partly(passages_: DataFrame, units: DataFrame) -> DataFrame:
    """(conv_id, said, turn) -> partly_at, for passages (with their text) that no message said whole.

    Equal passages are looked up once. A message that said more than half of n lines said one of any n - n/2, so
    only the rarest so many lines find candidates; which of these comes last before a quote is a running maximum
    on the passage's own timeline, so many quotes of a passage that many messages said make no pairs."""
    apart = passages_.groupBy("conv_id", "said").agg(F.first("text").alias("text"))
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda b: F.struct(normal(b).alias("block"), F.filter(F.transform(F.split(b, "\n"), normal), lambda x: x != "").alias("lines"))), lambda b: F.size(b["lines"]) > 0)
    lines = apart.select("conv_id", "said", F.posexplode(blocks).alias("i", "b")).select("conv_id", "said", "i", "b.block", F.posexplode("b.lines").alias("j", "line"))
    lines = lines.select("conv_id", F.col("said").alias("passage"), "i", "j", F.explode(F.array_distinct(F.array(F.xxhash64("block"), F.xxhash64("line")))).alias("said"))
    wanted = lines.select("conv_id", "said").distinct()
    held = units.select("conv_id", "said", "turn").distinct().join(wanted, ["conv_id", "said"], "left_semi")
    often = held.groupBy("conv_id", "said").agg(F.count("*").alias("n"))
    lines = lines.join(often, ["conv_id", "said"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_line = lines.groupBy("conv_id", "passage", "i", "j").agg(F.sum("n").alias("n"))
    of = W.partitionBy("conv_id", "passage")
    ranked = by_line.select("conv_id", "passage", "i", "j", F.row_number().over(of.orderBy("n", "i", "j")).alias("rank"), F.count("*").over(of).alias("size"))
    lines = lines.join(ranked, ["conv_id", "passage", "i", "j"]).where("n > 0")
    rare = lines.where("rank <= size - floor(size / 2)").join(held, ["conv_id", "said"]).select("conv_id", "passage", "turn").distinct()
    scored = rare.join(lines, ["conv_id", "passage"]).join(held, ["conv_id", "said", "turn"], "left_semi")
    scored = scored.groupBy("conv_id", "passage", "turn", "size").agg(F.count_distinct("i", "j").alias("score")).where("2 * score > size")
    events = scored.select("conv_id", F.col("passage").alias("said"), "turn", F.struct("score", "turn").alias("best"))
    events = events.unionByName(passages_.select("conv_id", "said", "turn").distinct(), allowMissingColumns=True)
    earlier = W.partitionBy("conv_id", "said").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = events.withColumn("partly_at", F.max("best").over(earlier)["turn"])
    return found.where("best is null and partly_at is not null").select("conv_id", "said", "turn", "partly_at")


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message) -> reply_to, n_quotes, n_linked, for messages that quote; message is the row's hash."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + QUOTED) & F.col("turn").isNotNull()).dropDuplicates(["conv_id", "turn", "message"])
    quotes = quoted_passages(quoting).withColumn("said", F.xxhash64(normal(F.col("text"))))
    wanted = quotes.select("conv_id", "said").distinct()
    own = unquoted(F.col("text"))
    units = F.array_distinct(F.concat(F.array(normal(own)), F.transform(F.split(own, r"\n\s*\n"), normal), F.transform(F.split(own, "\n"), normal)))
    original = messages.where(F.col("turn").isNotNull()).join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")
    original = original.select("conv_id", "turn", F.explode(F.filter(units, lambda u: u != "")).alias("unit")).withColumn("said", F.xxhash64("unit"))
    first = original.groupBy("conv_id", "said").agg(F.min("turn").alias("said_at"))
    linked = quotes.join(wanted.join(first, ["conv_id", "said"]), ["conv_id", "said"], "left").withColumn("said_at", F.when(F.col("said_at") < F.col("turn"), F.col("said_at")))
    linked = materialize(linked, "quotes")
    if not linked.where("said_at is null").isEmpty():  # no passage is open: nothing to link by lines
        partly = link_partly(linked.where("said_at is null"), original)
        linked = linked.join(partly, ["conv_id", "said", "turn"], "left").withColumn("said_at", F.coalesce("said_at", "partly_at"))
    best = F.min(F.when(F.col("said_at").isNotNull(), F.struct("level", (-F.col("said_at")).alias("neg"))))
    return linked.groupBy("conv_id", "turn", "message").agg((-best["neg"]).alias("reply_to"), F.count("*").alias("n_quotes"), F.count("said_at").alias("n_linked"))


def reply_order(conversations: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, content (without quotes), reply_to (null: the turn before), n_quotes, n_linked, position."""
    messages = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    messages = messages.withColumn("message", F.xxhash64("role", "text"))
    rows = messages.join(link_quotes(messages), ["conv_id", "turn", "message"], "left")
    rows = rows.select("conv_id", "turn", "role", "message", unquoted(F.col("text")).alias("content"), "reply_to", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    rows = rows.withColumn("at", F.coalesce("reply_to", F.col("turn") - 1, F.lit(_LAST)))
    order = [F.asc_nulls_first("conv_id"), F.asc("at"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("message")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "reply-order")
    counts = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    placed = rows.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return placed.select("conv_id", "turn", "role", "content", "reply_to", "n_quotes", "n_linked", (F.col("base") + F.col("place") + 1).alias("position"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row per conversation part of up to PART messages: its messages' turns in reply order and its chat text."""
    rows = reply_order(conversations).withColumn("part", F.floor((F.col("position") - 1) / PART))
    said = F.concat(F.format_string(OPEN, "role"), F.col("content"), F.lit(CLOSE))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce(F.col("turn").cast("string"), F.lit("?")).alias("turn"), said.alias("said")))).alias("m"), F.count("*").alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"))
    return parts.select("conv_id", "part", "n_messages", "n_quotes", "n_linked", F.array_join("m.turn", " ").alias("turns"), F.array_join("m.said", "").alias("chat"))
