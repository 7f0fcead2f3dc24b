"""Exact distinct counts that add up: visitors and sessions as bitmaps per day and domain.

Who visits gets a dense number once, in a dictionary that only grows. A day's visitors of a
domain are then bits: a row for each 32,768 numbers that occur. Bitmaps of days, or of domains, are
combined by OR, so any window is answered from the rollup without reading a hit, and the same rollup
serves all windows; counts are exact, unlike sketches. A very busy visitor is one bit a day.

Null visitors aren't counted, as count(DISTINCT) doesn't; a null domain is a domain. An empty table
gives an empty rollup. The same hits rolled up twice would count views twice: roll up whole days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import written


def dictionary(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(column, number): the known ones, and new values numbered on from them in ascending order, without gaps."""
    new = values.select(column).where(F.col(column).isNotNull()).distinct()
    first = 0
    if known is not None:
        new = new.join(known.select(column), column, "left_anti")
        first = (known.agg(F.max("number")).first()[0] or -1) + 1 if not known.isEmpty() else 0
    ranged = written(new.repartitionByRange(column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    made = ranged.join(F.broadcast(sizes.select("_range", before.alias("_base"))), "_range").select(column, (F.lit(first) + F.col("_base") + F.col("_at")).alias("number"))
    return made if known is None else known.select(column, "number").unionByName(made)


def rollup(hits: DataFrame, numbers: DataFrame, column: str = "visitor") -> DataFrame:
    """day, domain, bucket, seen, views: a bitmap of who was there for each bucket of numbers. Views stand in the bucket of who made them."""
    rows = hits.select("day", "domain", column).join(numbers, column, "left")
    bucket = F.coalesce(F.bitmap_bucket_number(F.col("number")), F.lit(0)).alias("bucket")
    return rows.groupBy("day", "domain", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("number"))).alias("seen"), F.count("*").alias("views"))


def totals(rolled: DataFrame, *keys: str | Column) -> DataFrame:
    """Exact distinct counts and views of the rollup's rows, by keys (none: of all)."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rolled.select(*(F.col(k).alias(n) if isinstance(k, str) else k.alias(n) for n, k in zip(names, keys)), "bucket", "seen", "views")
    parts = rows.groupBy(*names, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("seen")).alias("n"), F.sum("views").alias("views"))
    made = parts.groupBy(*names).agg(F.sum("n").alias("visitors"), F.sum("views").alias("views"))
    return made.withColumnsRenamed({n: k for n, k in zip(names, keys) if isinstance(k, str)})


def moving(rolled: DataFrame, days: int) -> DataFrame:
    """day, domain, visitors, views of the `days` days that end there, for every day with a hit or within `days` after one."""
    day = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_format(F.date_add(F.to_date("day"), i), "yyyy-MM-dd")))
    return totals(rolled.withColumn("day", day), "day", "domain")
