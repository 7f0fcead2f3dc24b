"""Keyed merges as single plans: every row's fate is a column, nothing is folded row by row."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: What can become of a key in a merge.
ACTIONS = ("added", "updated", "unchanged", "rejected", "kept")


def last_in_batch(incoming: DataFrame, key: str, release: str, ordinal: str | Column) -> DataFrame:
    """Of rows with one key in a batch, the one that stands after applying them in order: the newest
    release, and of equal releases the last in order."""
    order = W.partitionBy(key).orderBy(F.desc(release), F.desc(ordinal))
    return incoming.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, release: str, compared: list[str]) -> DataFrame:
    """Every key's `action` and surviving values: added, rejected (older release), unchanged (same
    compared values; stored metadata stays), updated, kept."""
    columns = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*columns).alias("o"))
    new = incoming.select(key, F.struct(*columns).alias("n"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "kept").when(F.col(f"n.{release}") < F.col(f"o.{release}"), "rejected").when(same, "unchanged").otherwise("updated")
    joined = old.join(new, key, "full").withColumn("action", action)
    kept = F.when(F.col("action").isin("added", "updated"), F.col("n")).otherwise(F.col("o"))
    return joined.withColumn("_s", kept).select(key, "action", *(F.col(f"_s.{c}").alias(c) for c in columns))


def merge_vintages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Forecast rows (id, day_id, value): a new id is added; the same id and value is skipped; the same
    id with another value gets its day id; a day id taken by another value is a conflict and the stored
    one stays."""
    by_id = existing.select(F.col("id").alias("_id"), F.col("value").alias("_v"))
    by_day = existing.select(F.col("id").alias("_day"), F.col("value").alias("_dv"))
    j = incoming.join(by_id, F.col("id") == F.col("_id"), "left").join(by_day, F.col("day_id") == F.col("_day"), "left")
    action = F.when(F.col("_id").isNull(), "added").when(F.col("_v") == F.col("value"), "skipped").when(F.col("_day").isNull(), "re-identified").when(F.col("_dv") == F.col("value"), "skipped").otherwise("conflict")
    return j.withColumn("action", action).withColumn("stored_id", F.when(F.col("action") == "re-identified", F.col("day_id")).otherwise(F.col("id"))).drop("_id", "_v", "_day", "_dv")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """What of incoming is to be added: keys not stored, the first of each."""
    order = W.partitionBy(*keys).orderBy(ordinal)
    return incoming.join(existing, keys, "left_anti").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def fill_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored fields stay; only missing ones are taken from incoming."""
    columns = [c for c in existing.columns if c != key]
    new = incoming.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns))
    return existing.join(new, key, "full").select(key, *(F.coalesce(c, f"_n_{c}").alias(c) for c in columns))


def replace_rows(existing: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Judged rows replace those with their key; the others stay."""
    return existing.join(judged.select(key), key, "left_anti").unionByName(judged)


def plan_rejudge(items: DataFrame, cache: DataFrame, key: str, version: str) -> DataFrame:
    """items with `plan`: ask (never judged, or judged under another version with a changed topic), carry
    (judged under another version, topic unchanged), keep (judged under this version)."""
    c = cache.select(key, F.col("version").alias("_v"), F.col("topic").alias("_t"))
    plan = F.when(F.col("_v").isNull(), "ask").when(F.col("_v") == version, "keep").when(~F.col("topic").eqNullSafe(F.col("_t")), "ask").otherwise("carry")
    return items.join(c, key, "left").withColumn("plan", plan).drop("_v", "_t")


def digest_of(columns: list[str]) -> list[Column]:
    """The parts of a table's content hash, as aggregates that don't depend on row order: `rows` and the sums of
    the halves of each row's hash."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return [F.count("*").alias("rows"), part(0).cast("string").alias("low"), part(1).cast("string").alias("high")]


def digest_text(parts: dict) -> str:
    """The content hash of the parts of digest_of."""
    return sha256("-".join(str(parts[k]) for k in ("rows", "low", "high") if parts[k] is not None).encode()).hexdigest()


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """A content hash of a table that is combined before any shuffle: the row count and a hash."""
    return df.agg(*digest_of(columns)).select("rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), "low", "high"), 256).alias("digest"))


def count_mismatches(expected: DataFrame, actual: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Groups whose counts differ, or that are required and empty."""
    e, a = expected.select(key, F.col("n").alias("expected")), actual.select(key, F.col("n").alias("actual"))
    j = e.join(a, key, "full").na.fill(0, ["expected", "actual"])
    return j.where((F.col("expected") != F.col("actual")) | (F.col(key).isin(required) & (F.col("actual") == 0)))


def merge_schedules(stored: DataFrame, fresh: DataFrame, keys: list[str], day: str, today: str, keep_days: int = 3) -> DataFrame:
    """Stored entries win over fresh ones of the same key, of which the earliest, least row is taken; those older than keep_days before today go."""
    rest = [day, *sorted(c for c in fresh.columns if c not in (*keys, day))] if day not in keys else sorted(c for c in fresh.columns if c not in keys)
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first")).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)) if rest else fresh.distinct()
    added = first.select(*fresh.columns).join(stored, keys, "left_anti")
    return stored.unionByName(added).where(F.col(day) >= F.date_sub(F.to_date(F.lit(today)), keep_days))


def overlay(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows with the verdicts that exist for them; untouched rows keep their own."""
    shared = [c for c in verdicts.columns if c != key]
    new = verdicts.select(key, *(F.col(c).alias(f"_n_{c}") for c in shared))
    j = rows.join(new, key, "left")
    return j.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in shared else F.col(c) for c in rows.columns))


def replace_run(manifest: DataFrame, ran: DataFrame, key: str) -> DataFrame:
    """A partial run's manifest: collectors that ran are replaced, the others keep what they had."""
    return manifest.join(ran.select(key), key, "left_anti").unionByName(ran)


def shrunk(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that would be lost by replacing a table: anything here means that it must not be written."""
    return before.select(*keys).distinct().join(after, keys, "left_anti")


def carried(verdicts: DataFrame, version: str) -> DataFrame:
    """Verdicts of an older version taken over under a new one; where they came from stays on record."""
    return verdicts.withColumn("carried_from", F.col("version")).withColumn("version", F.lit(version))


def refreshed(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows, replaced where a fresh row has something to replace them with; fresh keys not stored are added."""
    columns = [c for c in stored.columns if c != key]
    new = fresh.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns))
    j = stored.join(new, key, "full")
    return j.select(key, *(F.coalesce(f"_n_{c}", c).alias(c) for c in columns)).where(" or ".join(f"{c} is not null" for c in columns))


def plan_narrow(items: DataFrame, cache: DataFrame, key: str, version: str) -> DataFrame:
    """What to do once the criteria became narrower: items without a verdict are unjudged, those judged by this
    version are kept, picks are asked again, and rejects are carried, since a narrower threshold rejects them too."""
    j = items.join(cache.select(key, "version", "pick"), key, "left")
    return j.withColumn("plan", F.when(F.col("version").isNull(), "unjudged").when(F.col("version") == version, "keep").when(F.col("pick"), "ask").otherwise("carry"))
