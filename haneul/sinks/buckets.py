"""A keyed table in buckets, of which a merge rewrites the touched ones alone.

Rows lie in buckets by a hash of their key, each bucket in folders that are never changed. A version
is a file of the log that says which folder holds each bucket; a merge reads and writes only the buckets
that its keys fall into and carries the other folders over by name. The log's file is made anew or not
at all, so readers see a whole version or the one before, a job that dies leaves the table as it was, and
of two writers of one version the second fails. A micro-batch that the log names is passed over.

Of rows with one key in a batch the newest release stands, and of equal ones the greatest row. A null key
is a key. Small batches on a large table cost their buckets; choose as many buckets as one bucket is a task's work.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import fresh_dir
from ..operators import versioning


class Buckets:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def newest(self) -> dict | None:
        fs, path = self._path("log")
        if not fs.exists(path):
            return None
        last = max(s.getPath().getName() for s in fs.listStatus(path))
        return json.loads(self.spark.read.text(f"{self.root}/log/{last}", wholetext=True).first()[0])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The newest version; of the given buckets alone, if any are given."""
        at = self.newest()
        held = {int(b): f for b, f in (at["folders"] if at else {}).items() if only is None or int(b) in only}
        paths = [f"{self.root}/{f}/_bucket={b}" for b, f in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, incoming: DataFrame, release: str, compared: list[str], batch: int | None = None) -> dict[str, int]:
        """Merge rows; returns the number of keys of touched buckets by action. {} for a batch that ran already."""
        at = self.newest()
        if batch is not None and at and at["batch"] is not None and at["batch"] >= batch:
            return {}
        last = F.struct(*sorted(c for c in incoming.columns if c not in (self.key, release)))
        rows = versioning.last_in_batch(incoming, self.key, release, last)
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # a bucket's number each
        seen = Observation()
        merged = versioning.upsert(self.read(touched), rows, self.key, release, compared)
        merged = merged.observe(seen, *(F.count_if(F.col("action") == a).alias(a) for a in versioning.ACTIONS)).drop("action")
        folder = fresh_dir(self.spark, "v").rsplit("/", 1)[1]
        merged.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        counts = {a: seen.get[a] for a in versioning.ACTIONS if seen.get.get(a)}
        folders = (at["folders"] if at else {}) | {str(b): folder for b in touched}
        entry = {"version": at["version"] + 1 if at else 1, "batch": at["batch"] if at and batch is None else batch, "folders": folders, "touched": touched, "counts": counts}
        fs, name = self._path(f"log/{entry['version']:012d}.json")
        out = fs.create(name, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return counts
