"""What the corpus operators share: shared storage, sized joins and ordered ranges."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed value: the code points that separate words, as a character class.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that one Python batch takes at a time, so that a batch of long texts isn't held twice.
SLICE = 256


def words_of(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, as UTF-8; bytes.split() cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def released() -> None:
    """Give back to the system what this worker's allocators hold but don't use; workers outlive stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(values) -> Iterator[list]:
    """A pyarrow array as lists of at most SLICE Python values."""
    for i in range(0, len(values), SLICE):
        yield values.slice(i, SLICE).to_pylist()
    released()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a folder in the warehouse becomes it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("haneul.shared.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark)}/haneul-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: it cuts the lineage and outlives executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, salt_from: Column, max_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Join a table with one small row per group. Up to max_rows groups are broadcast; beyond
    that each group's row is copied to `salts` salted keys, so a group that holds a third of
    the left rows is dealt over that many tasks. salt_from must be a function of the row."""
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_hn_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_hn_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, "_hn_salt"], how).drop("_hn_salt")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """The rows with their place, from 0, in the order: places within ranges of it plus the counts of the
    ranges before, a row per range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("_hn_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_hn_at")), "ranges")
    before = W.orderBy("_hn_range").rowsBetween(W.unboundedPreceding, -1)
    base = ranged.groupBy("_hn_range").agg(F.count("*").alias("n")).select("_hn_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_hn_base"))
    return ranged.join(base, "_hn_range").withColumn(out, F.col("_hn_base") + F.col("_hn_at")).drop("_hn_range", "_hn_at", "_hn_base")


def arrow_column(ddl: str) -> Callable:
    """arrow_udf for functions at module level: the type is parsed when the column is first asked for, as workers import modules without a session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        return wraps(f)(lambda *columns: arrow_udf(f, ddl)(*columns))

    return wrap
