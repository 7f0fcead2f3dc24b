"""Collectors by name: functions of (spark, today) that return a frame of a known table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Collector = Callable[[SparkSession, str], DataFrame]


class Collectors:
    def __init__(self) -> None:
        self.known: dict[str, Collector] = {}

    def register(self, name: str) -> Callable[[Collector], Collector]:
        def wrap(f: Collector) -> Collector:
            self.known[name] = f
            return f

        return wrap

    def run(self, spark: SparkSession, today: str, only: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
        """Rows of all collectors that work, and a manifest row for each: one that fails doesn't stop the others."""
        rows, manifest = None, []
        for name in only or list(self.known):
            try:
                df = self.known[name](spark, today).withColumn("collector", F.lit(name))
                n = df.count()
                rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
                manifest.append((name, True, n, None))
            except Exception as e:  # the manifest tells
                manifest.append((name, False, 0, str(e).split("\n")[0][:300]))
        return rows, spark.createDataFrame(manifest, "name string, ok boolean, fetched long, error string")


class DocumentSources:
    """Document sources by key: each gives its documents' descriptions, and their pages when they are asked for."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[[SparkSession], DataFrame], Callable[[SparkSession, DataFrame], DataFrame]]] = {}

    def register(self, key: str, documents: Callable[[SparkSession], DataFrame], pages: Callable[[SparkSession, DataFrame], DataFrame]) -> None:
        if key in self.known:
            raise ValueError(f"{key} is registered twice")
        self.known[key] = (documents, pages)

    def documents(self, spark: SparkSession, key: str) -> DataFrame:
        return self.known[key][0](spark)

    def pages(self, spark: SparkSession, key: str, chosen: DataFrame | None = None) -> DataFrame:
        """The pages of the chosen documents (all of them by default); no other document is opened."""
        documents, pages = self.known[key]
        return pages(spark, documents(spark) if chosen is None else chosen)
