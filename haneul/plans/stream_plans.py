"""Streaming twins of visit plans: the same questions, asked of a stream over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import local_day
from ..streaming import beacons
from . import views
from .registry import Registry

R = Registry(views.VIEWS)


def _stream(spark, sf):
    """events.parquet as a stream source (a glob, for it may be a file or a folder)."""
    schema = views.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf}/event[s].parquet")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), local_day(F.col("ts")).alias("day"), F.col("event_type").alias("domain"), F.col("user_id").alias("visitor"))


@R.add("s01_daily_views", "SELECT day, domain, count(*) AS views FROM hit0 GROUP BY 1, 2", ("hit0",))
def _(spark, sf):
    return beacons.drain(beacons.daily_views(_stream(spark, sf)), spark, "complete")


@R.add("s02_sessions", "SELECT visitor, count(*) AS sessions, CAST(sum(views) AS BIGINT) AS views FROM (SELECT visitor, session, count(*) AS views FROM hit1 GROUP BY 1, 2) GROUP BY 1", ("hit0", "hit1"))
def _(spark, sf):
    made = beacons.drain(beacons.sessions(_stream(spark, sf)), spark, "complete")
    return made.groupBy("visitor").agg(F.count("*").alias("sessions"), F.sum("views").alias("views"))


@R.add("s03_visitor_state", "SELECT CAST(visitor AS VARCHAR) AS visitor, CAST(sum(n) AS BIGINT) AS hits, min(day) AS first_day, CAST(sum(least(n, 3)) AS BIGINT) AS kept FROM (SELECT visitor, day, count(*) AS n FROM hit0 GROUP BY 1, 2) GROUP BY 1", ("hit0",))
def _(spark, sf):
    made = beacons.drain(beacons.visitor_stream(_stream(spark, sf), 3), spark)
    return made.groupBy("visitor").agg(F.max("hits").alias("hits"), F.min("first_day").alias("first_day"), F.count_if("kept").alias("kept"))


@R.add("s04_quotas", "SELECT CAST(visitor AS VARCHAR) AS ip, day, count(*) AS n, count(*) > 4 AS over FROM hit0 GROUP BY 1, 2", ("hit0",))
def _(spark, sf):
    asked = _stream(spark, sf).select(F.col("visitor").cast("string").alias("ip"), "ts")
    return beacons.drain(beacons.quotas(asked, 4), spark, "complete")
