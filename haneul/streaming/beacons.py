"""Visits as a stream: beacons to hits, windows by event time, a visitor's state, merged snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import local_day
from ..functions.text import device, host, is_bot, page_path, referrer_kind
from ..sinks.tables import Versions

BODY = "domain string, path string, visitor string, session string, ref string, mode string"
CAP = 500


def _short(c: str, most: int):
    return F.when(F.length(c).between(1, most), F.col(c))


def hits_of(beacons: DataFrame, domains: list[str]) -> DataFrame:
    """Beacons (id, ts, body JSON, ua, country) as hits; bots, bodies that aren't JSON, unknown domains and
    overlong ids are dropped. No state, so it serves streams and tables alike."""
    rows = beacons.withColumn("b", F.from_json("body", BODY)).where(~is_bot(F.col("ua"))).select("id", "ts", "ua", "country", "b.*")
    ref = F.when(F.col("ref").rlike("^https?://"), host(F.col("ref")))
    made = rows.select(
        "id", "ts", local_day(F.col("ts")).alias("day"), "domain", page_path(F.coalesce(_short("path", 200), F.lit("/"))).alias("path"), _short("visitor", 64).alias("visitor"), _short("session", 64).alias("session"),
        ref.alias("ref"), referrer_kind(ref).alias("ref_kind"), F.coalesce("mode", F.lit("browser")).alias("mode"), device(F.col("ua")).alias("device"), "country",
    )
    return made.where(F.col("domain").isin(*domains) & F.col("visitor").isNotNull() & F.col("session").isNotNull())


def daily_views(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """Views by day at UTC+9 and domain; hits later than `late` behind the newest are not counted any more."""
    made = hits.withWatermark("ts", late).groupBy(F.window("ts", "1 day", startTime="15 hours").alias("w"), "domain").agg(F.count("*").alias("views"))
    return made.select(F.date_format(F.col("w.start") + F.expr("interval 9 hours"), "yyyy-MM-dd").alias("day"), "domain", "views")


def sessions(hits: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    made = hits.withWatermark("ts", late).groupBy("visitor", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("views"))
    return made.select("visitor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "views")


KEPT = "visitor string, id long, day string, kept boolean, hits long, first_day string"
#: How long after its end a day's count is kept for late hits, and after its last hit a visitor's summary.
DAY_KEPT, VISITOR_KEPT = timedelta(hours=48), timedelta(days=400)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VisitorDays(StatefulProcessor):
    """A visitor's state: first day and hits, and a map from day to that day's hits. Event-time timers give a
    day's count up DAY_KEPT after the day and everything VISITOR_KEPT after the last hit; a visitor has one timer,
    for what ends first. A day that the next watermark, at least the last hit less `late`, gives up isn't stored."""

    def __init__(self, cap: int, day_kept: timedelta = DAY_KEPT, visitor_kept: timedelta = VISITOR_KEPT, late: timedelta = timedelta.max) -> None:
        self.cap, self.day_kept, self.visitor_kept, self.late = cap, _millis(day_kept), _millis(visitor_kept), _millis(late)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", "first_day string, hits long, last long, timer long")
        self.days = handle.getMapState("days", "day string", "hits long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.summary.get()
        first, n, last, timer = old or (None, 0, 0, None)
        now, ahead, counts, stored = timerValues.getCurrentWatermarkInMs(), 0, {}, set()
        for r in sorted(rows, key=lambda r: (r["day"], r["id"])):
            day = r["day"]
            first, n, last = min(first or day, day), n + 1, max(last, r["at"])
            if r["ts"] is not None:
                ahead = max(ahead, r["at"] - self.late)
            if day not in counts:
                counts[day] = 0
                if old and self.days.containsKey((day,)):
                    counts[day] = self.days.getValue((day,))[0]
                    stored.add(day)
            counts[day] += 1
            yield Row(visitor=key[0], id=r["id"], day=day, kept=_day_end(day) + self.day_kept > now and counts[day] <= self.cap, hits=n, first_day=first)
        ends = [last + self.visitor_kept]
        for day, hits in counts.items():
            until = _day_end(day) + self.day_kept
            if until > max(now, ahead) or day in stored:
                self.days.updateValue((day,), (hits,))
                ends.append(until)
        due = max(min(ends), now + 1)
        if timer is None or now < timer and due < timer:  # a timer that is due runs after the rows, and sets the next
            timer = due
            self.handle.registerTimer(timer)
        self.summary.update((first, n, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, old = timerValues.getCurrentWatermarkInMs(), self.summary.get()
        if old and old[3] <= now:
            first, n, last, _ = old
            ends = [last + self.visitor_kept]
            if ends[0] <= now:
                self.summary.clear()
                self.days.clear()
                return iter([])
            for (day,) in list(self.days.keys()):
                until = _day_end(day) + self.day_kept
                if until <= now:
                    self.days.removeKey((day,))
                else:
                    ends.append(until)
            self.handle.registerTimer(min(ends))
            self.summary.update((first, n, last, min(ends)))
        return iter([])

    def close(self) -> None:
        pass


_EPOCH = datetime(1970, 1, 1)


def _millis(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)


def _day_end(day: str) -> int:
    """The end of a day at UTC+9, in milliseconds."""
    return _millis(datetime.fromisoformat(day) - _EPOCH) + 15 * 3_600_000


def visitor_stream(hits: DataFrame, cap: int = CAP, late: str = "48 hours", day_kept: timedelta = DAY_KEPT, visitor_kept: timedelta = VISITOR_KEPT) -> DataFrame:
    """Each hit (id, ts, day, visitor) with whether it is kept - `cap` a visitor and day, first by id of those
    that come together - and its visitor's running state. Hits of a day that is given up, or later than
    `late` behind the newest, are not kept; state lives in RocksDB, a change at a time."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    behind = hits.sparkSession.sql("SELECT unix_millis(timestamp_millis(0) + CAST(:late AS INTERVAL))", {"late": late}).first()[0]
    rows = hits.select(F.col("visitor").cast("string").alias("visitor"), "id", "ts", "day", F.coalesce(F.unix_millis("ts"), F.unix_millis(F.to_timestamp("day"))).alias("at")).withWatermark("ts", late)
    return rows.groupBy("visitor").transformWithState(VisitorDays(cap, day_kept, visitor_kept, timedelta(milliseconds=behind)), KEPT, "Append", "EventTime")


def quotas(requests: DataFrame, limit: int, late: str = "48 hours") -> DataFrame:
    """Requests by address and day, and whether the day's quota is used up; a day's count is dropped `late` after it."""
    day = F.window("ts", "1 day", startTime="15 hours")
    made = requests.withWatermark("ts", late).groupBy("ip", day.alias("w")).agg(F.count("*").alias("n"))
    return made.select("ip", F.date_format(F.col("w.start") + F.expr("interval 9 hours"), "yyyy-MM-dd").alias("day"), "n", (F.col("n") > limit).alias("over"))


def merge_snapshots(stream: DataFrame, spark: SparkSession, root: str, checkpoint: str, key: str, release: str, compared: list[str]):
    """Upsert each micro-batch into a versioned table; of a batch's rows with one key the last stands. The log
    names the batch with its version, so a batch that is run again is passed over by its number."""
    table = Versions(spark, root)

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, key, release, compared, batch=number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result. Complete mode keeps the last state alone."""
    from ..functions.storage import fresh_dir

    out, root = stream.writeStream.outputMode(mode), fresh_dir(spark, "stream")

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={n}")

    out.foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)
