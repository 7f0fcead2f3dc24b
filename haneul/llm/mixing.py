"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target number of words and a schedule of its weight over training time
(knots, linear between them). The schedule is integrated to the share of the source's words
that training has asked for by time t. A source's documents, in a fixed pseudo-random order,
supply its words; running totals give each document (and each repeat of it) its place in the
supply, and inverting the cumulative demand gives its training position in [0, 1). Rows
sorted by position are the training order.

Running totals work in two levels: sums per (source, bucket of the order's hash) are added up
over a source's buckets, then rows within a bucket. Buckets hold about ROWS_A_BUCKET rows, so
their number grows with the rows, and a source with a third of all rows is dealt over a third
of them. The order depends on ids, texts, sizes and the seed alone: reruns agree. mix() deals
texts by bucket and sorts them by position: two shuffles of the texts, and no join to them.

Targets: sources by code point, null last, weigh `weights`, repeating, and share `share`
times all words; a target stops at `max_repeat` times its source, and the excess is shared
again by weight among the rest until none is above. The last document that a source needs is
taken in part (in words), so a source's taken words meet its target to within one word. Ranks
of sources come from ranges of the sorted sources, and each round of sharing is one sum over
them, so sources may be many.

Nulls: a null text has size 0; a null source is a source of its own; a null id is an id.
Repeated rows are documents each. Very long texts are counted whole. Sources without words
have target 0. Empty tables give empty results; mix() keeps the columns of docs, the plan none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, numbered, spread_join

ROWS_A_BUCKET = 1024
#: Buckets of a source are added up in one task: 2^16 at most, and more rows a bucket beyond.
MAX_BITS = 16
#: (time, weight) knots for the 1st, 2nd, 3rd source in code point order, repeating.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """(key, source, source_size) with rank and target. `level` is what a unit of weight gets: sources
    whose part would be above their cap get the cap, the rest share again, which only raises the
    level, so each round caps more sources until none is above."""
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", w), "sources")
    cap = (F.lit(max_repeat) * F.col("source_size")).cast("double")
    total, level = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        used, left = ranked.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        rest = (share * total - used) / left if left else 0.0
        if rest <= level * (1 + 1e-12):
            break
        level = rest
    return ranked.select("key", "source", "source_size", "rank", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def segments(schedules=SCHEDULES) -> Column:
    """For the source's rank: the integrated schedule as segments (t0, t1, w0, w1, d0, d1), d scaled to end at 1."""
    arrays = []
    for knots in schedules:
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        done, own = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            d0, done = done, done + (t1 - t0) * (w0 + w1) / 2 / area
            own.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("t0", "t1", "w0", "w1", "d0", "d1"), (t0, t1, w0 / area, w1 / area, d0, done)))))
        arrays.append(F.array(*own))
    return F.element_at(F.array(*arrays), (F.pmod(F.col("rank"), F.lit(len(schedules))) + 1).cast("int"))


def invert(u: Column, of: Column) -> Column:
    """The time at which the cumulative demand is u: within a segment demand is a quadratic of time."""
    s = F.coalesce(F.get(F.filter(of, lambda x: u < x["d1"]), F.lit(0)), F.element_at(of, -1))
    span, slope = s["t1"] - s["t0"], (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    gap = F.greatest(u - s["d0"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * gap, F.lit(0.0)))
    return F.least(s["t0"] + F.least(2 * gap / (s["w0"] + root), span), F.lit(1.0))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, max_repeat: int, seed: int, schedules, carried: list[str]) -> DataFrame:
    """The plan's rows, with the columns `carried` of docs beside them."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    own = [F.col(id_col).alias("_hn_id"), F.col(source_col).alias("_hn_source"), key.alias("_hn_key"), size.alias("_hn_size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hn_h")]
    bits = min(MAX_BITS, (docs.count() // ROWS_A_BUCKET).bit_length())
    bucket = F.shiftrightunsigned("_hn_h", 64 - bits) if bits else F.lit(0).cast("long")
    small = docs.select(*own).withColumn("_hn_bucket", bucket)
    if not carried:
        small = materialize(small, "sizes")
    sums = materialize(small.groupBy(F.col("_hn_key").alias("key"), F.col("_hn_bucket").alias("bucket")).agg(F.sum("_hn_size").alias("n"), F.first("_hn_source").alias("source")), "buckets")
    aims = targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("n").alias("source_size")), weights, share, max_repeat)
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = materialize(spread_join(base, aims, ["key"], "inner", F.col("bucket")).drop("source"), "places")  # a row per source and bucket
    rows = docs.select(*(F.col(c) for c in carried), *own).withColumn("_hn_bucket", bucket) if carried else small
    dealt = rows.repartition("_hn_key", "_hn_bucket").join(placed.hint("shuffle_hash"), (F.col("_hn_key") == F.col("key")) & (F.col("_hn_bucket") == F.col("bucket"))).drop("key", "bucket")
    inside = W.partitionBy("_hn_key", "_hn_bucket").orderBy("_hn_h", F.col("_hn_id").asc_nulls_first(), "_hn_size").rowsBetween(W.unboundedPreceding, -1)
    run = dealt.withColumn("start", F.col("base") + F.coalesce(F.sum("_hn_size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(1e-6)).cast("long")
    part = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("_hn_size"))
    run = run.withColumn("whole", whole).withColumn("rest", rest).withColumn("part", part)
    of = segments(schedules)
    position = lambda k: invert(((k * F.col("source_size") + F.col("start")).cast("double") + 0.5) / (F.col("target") + 1), of)
    copy = lambda k: F.struct(k.cast("int").alias("copy"), F.when(k < F.col("whole"), F.col("_hn_size")).when(k == F.col("whole"), F.col("part")).otherwise(0).alias("words"), position(k).alias("position"))
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeat)), copy), lambda c: c["words"] > 0)
    taken = (F.col("whole") * F.col("_hn_size") + F.col("part")).alias("_hn_taken")
    return run.select(*carried, "_hn_id", "_hn_source", "_hn_size", F.col("source_size").alias("_hn_source_size"), F.col("target").alias("_hn_target"), taken, copies.alias("_hn_copies"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, seed: int = 11, schedules=SCHEDULES) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, and `copies`, an
    array of (copy, words, position): how many of its words each copy gives, and when."""
    rows = _placed(docs, id_col, text_col, source_col, weights, share, max_repeat, seed, schedules, [])
    return rows.select(F.col("_hn_id").alias("doc_id"), *(F.col(f"_hn_{x}").alias(x) for x in ("source", "size", "source_size", "target", "taken", "copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, seed: int = 11, schedules=SCHEDULES) -> DataFrame:
    """The documents in training order, repeated as plan_mix() plans. A copy that is taken in part is
    given whole if the part is half of it or more, so that no text is cut: of each source, the one
    document that its target ends in."""
    rows = _placed(docs, id_col, text_col, source_col, weights, share, max_repeat, seed, schedules, docs.columns)
    given = F.filter("_hn_copies", lambda c: 2 * c["words"] >= F.col("_hn_size"))
    return rows.withColumn("_hn_copy", F.explode(given)).orderBy("_hn_copy.position", id_col).select(*docs.columns)
