"""Writing tables: in order, in shards, by version, behind a gate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import fresh_dir
from ..operators import versioning
from ..operators.quality import require


def save_sorted(df: DataFrame, path: str, order: list[str], fmt: str = "json") -> None:
    """One total order over all files: ranges of it are written by many tasks, and file names sort as it does."""
    df.orderBy(*order).write.mode("overwrite").format(fmt).save(path)


def save_shards(df: DataFrame, path: str, shard: str, light: list[str] | None = None) -> None:
    """A folder per shard; shards that no longer exist go. `light`: heavy columns to leave out."""
    (df.drop(*light) if light else df).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(shard).parquet(path)


class Versions:
    """A table in a folder per version, and a log of versions, a file each; readers take the newest.

    A version is written whole before the log names it, so a job that dies leaves the table as it
    was. Its digest, its rows and what a merge did are observed while it is written, in one pass. The
    log's file is made anew or not at all, so of two writers of one version the second fails."""

    LOG = "version long, path string, digest string, rows long, batch long, counts map<string,long>"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.counts: dict[str, int] = {}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _log(self) -> DataFrame:
        fs, path = self._path("log")
        return self.spark.read.schema(self.LOG).json(f"{self.root}/log") if fs.exists(path) else self.spark.createDataFrame([], self.LOG)

    def newest(self):
        rows = self._log().orderBy(F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def read(self, schema: str) -> DataFrame:
        at = self.newest()
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at.path}") if at else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, keys: list[str] | None = None, batch: int | None = None, action: str | None = None) -> bool:
        """Write a version unless its content equals the newest one's; with keys, refuse to lose any of them.
        With `action`, a column that isn't stored, the log and `counts` keep the number of rows by it."""
        at = self.newest()
        if at and keys:
            require(versioning.shrunk(self.spark.read.parquet(f"{self.root}/{at.path}"), df, keys), "keys would be lost")
        columns = sorted(c for c in df.columns if c != action)
        seen = Observation()
        counts = [F.count_if(F.col(action) == a).alias(a) for a in versioning.ACTIONS] if action else []
        path = fresh_dir(self.spark, "v").rsplit("/", 1)[1]
        df.observe(seen, *versioning.digest_of(columns), *counts).drop(*([action] if action else [])).write.parquet(f"{self.root}/{path}")
        found = seen.get
        self.counts = {a: found[a] for a in versioning.ACTIONS if found.get(a)}
        digest, number = versioning.digest_text(found), at.batch if at and batch is None else batch
        same = at is not None and at.digest == digest
        if same:
            fs, made = self._path(path)
            fs.delete(made, True)
            if number == at.batch:
                return False
        entry = {"version": at.version + 1 if at else 1, "path": at.path if same else path, "digest": digest, "rows": found["rows"], "batch": number, "counts": self.counts}
        fs, name = self._path(f"log/{entry['version']:012d}.json")
        out = fs.create(name, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def upsert(self, incoming: DataFrame, key: str, release: str, compared: list[str], ordinal: str | None = None, batch: int | None = None) -> dict[str, int]:
        """Merge rows into the newest version and return the number of keys by action, counted while the
        version is written. Of rows with one key the newest release is taken, and of equal ones the last by
        `ordinal`, or else the greatest row. A micro-batch that the log names already is passed over by its number."""
        at = self.newest()
        if batch is not None and at and at.batch is not None and at.batch >= batch:
            return {}
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in incoming.schema if f.name != ordinal)
        last = ordinal or F.struct(*sorted(c for c in incoming.columns if c not in (key, release)))
        merged = versioning.upsert(self.read(schema), versioning.last_in_batch(incoming, key, release, last).drop(*([ordinal] if ordinal else [])), key, release, compared)
        self.write(merged, batch=batch, action="action")
        return self.counts


def run_stamp(counts: DataFrame, required: list[str], ok: bool) -> DataFrame:
    """One row: whether a load is good: it ended well and no required domain is empty."""
    have = F.array_distinct(F.collect_list(F.when(F.col("n") > 0, F.col("domain"))))
    lacking = F.array_except(F.array(*map(F.lit, required)), have)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.array_join(lacking, ",").alias("lacking")).withColumn("ok", F.lit(ok) & (F.col("lacking") == ""))
