"""The state of runs: manifests as indicators, boards not yet registered, choices among attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.visits import elapsed_hours

MANIFEST = "struct<run_at:timestamp,at:timestamp,ok:boolean,errors:array<string>,rows:long>"


def indicators(manifests: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """Manifests (domain, body JSON) as figures and warnings. A body that isn't a manifest is malformed, not zero."""
    m = manifests.withColumn("m", F.from_json("body", MANIFEST))
    at = F.coalesce("m.run_at", "m.at")
    hours = F.when(at.isNotNull(), elapsed_hours(at, now))
    malformed = F.col("m").isNull() | at.isNull()
    warnings = F.filter(F.array(F.when(malformed, "malformed"), F.when(hours >= stale_hours, "stale"), F.when(F.size(F.coalesce("m.errors", F.array())) > 0, "errors")), lambda x: x.isNotNull())
    made = m.select("domain", at.alias("run_at"), F.col("m.rows").alias("rows"), hours.alias("hours"), malformed.alias("malformed"), warnings.alias("warnings"))
    return made.orderBy(F.desc(F.size("warnings") > 0), "domain")


def unregistered(menu: DataFrame, registered: DataFrame, url: str, order: str) -> DataFrame:
    """Links of a menu whose board isn't registered, in order of first sight; links are compared without query and final slash."""
    key = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", ""))
    known = registered.select(key(F.col(url)).alias("_k")).distinct()
    seen = menu.withColumn("_k", key(F.col(url))).groupBy("_k").agg(F.min_by(url, order).alias(url), F.min(order).alias("_o"))
    return seen.join(known, "_k", "left_anti").orderBy("_o").select(url)


def preferred(attachments: DataFrame, keys: list[str], ranks: list[str]) -> DataFrame:
    """Of each kind of attachment (url, kind) the one whose extension comes first in `ranks`; others are left out."""
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    rank = F.array_position(F.array(*map(F.lit, ranks)), ext)
    ranked = attachments.withColumn("_r", rank).where(F.col("_r") > 0)
    return ranked.groupBy(*keys, "kind").agg(F.min_by("url", F.struct("_r", "url")).alias("url"))


def needs_summary(posts: DataFrame, months: int) -> DataFrame:
    """Posts of the newest `months` months (counted over all posts) that have a document but no summary."""
    newest = posts.select("month").distinct().withColumn("_k", F.row_number().over(W.orderBy(F.desc("month")))).where(F.col("_k") <= months).select("month")  # a row per month
    return posts.join(newest, "month", "left_semi").where("summary is null and has_document")


def relinked(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows (org, title, url) with the link found for their title: how it was found is url, pair, none or unresolved."""
    j = rows.join(resolved.select("org", "title", F.col("landing").alias("_l"), F.col("file").alias("_f"), F.lit(True).alias("_s")), ["org", "title"], "left")
    how = F.when(F.col("_s").isNull(), "unresolved").when(F.col("_l").isNotNull() & F.col("_f").isNotNull(), "pair").when(F.col("_l").isNotNull(), "url").otherwise("none")
    return j.withColumn("how", how).withColumn("url", F.coalesce("_l", "url")).drop("_l", "_f", "_s")


def due_hours(day: Column, release_hour: int, every: int) -> Column:
    """The hours of a release day at which to look: the release's, the one after, then every `every` hours."""
    return F.array_distinct(F.concat(F.array(F.lit(release_hour), F.lit(release_hour + 1)), F.sequence(F.lit(release_hour + 1), F.greatest(F.lit(23), F.lit(release_hour + 1)), F.lit(every))))


def slots_done(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned (date, kind, release, hour) that haven't run yet today."""
    return planned.join(done, ["date", "kind", "release", "hour"], "left_anti")


#: What a domain's manifest looks like; the key under which it says when it ran comes first.
_COLLECTORS = ("run_at", "run_at string, collectors map<string,struct<ok:boolean,blocked:boolean>>, conflicts array<string>, errors array<string>")
_SHAPES = {
    "employment": _COLLECTORS, "forecast": _COLLECTORS, "press": ("run_at", "run_at string, rounds double, unjudged double"), "ask": ("run_at", "run_at string, catalog struct<ok:boolean>"),
    "reports": ("at", "at string, boards map<string,struct<ok:boolean>>, reports double, unregistered array<string>, sizes struct<abstracts_gzip:double,abstracts_shards_gzip:map<string,double>>, recommend struct<judged:double,error:string>"),
}
#: Fixed value: the size, compressed, beyond which a shard of abstracts is to be split.
SHARD_BYTES = 3 * 1_048_576
_TOO_LONG = 24


def _failed(boards: Column, blocked: bool | None = None) -> Column:
    """Names of a map's entries that aren't ok, in order; of those blocked or not blocked alone, if that is asked."""
    def bad(v: Column) -> Column:
        not_ok = F.coalesce(~v["ok"], F.lit(False))
        return not_ok if blocked is None else not_ok & (F.coalesce(v["blocked"], F.lit(False)) == F.lit(blocked))

    return F.array_join(F.array_sort(F.map_keys(F.map_filter(boards, lambda _, v: bad(v)))), ", ")


def _number(c: Column) -> Column:
    """Whole numbers without a fraction, as they are read."""
    return F.when(c == F.floor(c), F.format_string("%d", F.floor(c))).otherwise(c.cast("string"))


def _said(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _figure(label: str, value: Column, when: Column | None = None) -> Column:
    made = F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    return made if when is None else F.when(when, made)


def _adapted(domain: str, m: Column) -> tuple[Column, list[Column], list[Column]]:
    """(whether the manifest is readable, figures, warnings) of a domain's kind of manifest."""
    ran = m[_SHAPES[domain][0]].isNotNull()
    if _SHAPES[domain] is _COLLECTORS:
        failed, blocked = _failed(m["collectors"], False), _failed(m["collectors"], True)
        conflicts = F.size(F.coalesce(m["conflicts"], F.array()))
        n = F.size(F.map_filter(m["collectors"], lambda _, v: F.coalesce(~v["ok"], F.lit(False)) & ~F.coalesce(v["blocked"], F.lit(False))))
        return ran & m["collectors"].isNotNull() & m["errors"].isNotNull(), [_figure("수집기 실패", n), _figure("오류", F.size(m["errors"]))], [_said(failed != "", "수집기 실패: ", failed), _said(blocked != "", "봇 차단 중: ", blocked), _said(conflicts > 0, "충돌 ", conflicts.cast("string"), "건")]
    if domain == "press":
        open_ = m["unjudged"]
        return ran & m["rounds"].isNotNull(), [_figure("회차", _number(m["rounds"])), _figure("미판정", _number(open_), open_.isNotNull())], [_said(open_ > 0, "판정 없는 기사 ", _number(open_), "건 — 구독 판정이 막혔는지 보라")]
    if domain == "ask":
        ok = m["catalog"]["ok"]
        return ran & ok.isNotNull(), [_figure("카탈로그", F.when(ok, "정상").otherwise("실패"))], [_said(~ok, "카탈로그 갱신 실패")]
    failed, new = _failed(m["boards"]), F.size(F.coalesce(m["unregistered"], F.array()))
    total, shards = m["sizes"]["abstracts_gzip"], F.map_filter(m["sizes"]["abstracts_shards_gzip"], lambda _, v: v > 0)
    largest = F.array_max(F.transform(F.map_entries(shards), lambda e: F.struct(e["value"].alias("bytes"), e["key"].alias("org"))))
    megabytes = lambda c: F.format_string("%.2fMB", F.bround(c / 1_048_576, 2))  # halves to the even digit, as printf has it
    unjudged = F.when(m["recommend"]["judged"].isNotNull(), F.greatest(m["reports"] - m["recommend"]["judged"], F.lit(0.0)))
    figures = [
        _figure("게시판 실패", F.size(F.map_filter(m["boards"], lambda _, v: F.coalesce(~v["ok"], F.lit(False))))), _figure("전체 보고서", _number(m["reports"])), _figure("초록 gzip", megabytes(total), total > 0),
        _figure("최대 조각", F.concat(largest["org"], F.lit(" "), megabytes(largest["bytes"])), largest.isNotNull()), _figure("미판정", F.coalesce(_number(unjudged), F.lit("판정 기록 없음"))),
    ]
    warnings = [
        _said(failed != "", "게시판 실패: ", failed), _said(new > 0, "미등록 게시판 ", new.cast("string"), "건"), _said(largest["bytes"] > SHARD_BYTES, "초록 조각 ", largest["org"], " ", megabytes(largest["bytes"]), " — 또 쪼갤 때다"),
        _said(largest.isNull() & (total > SHARD_BYTES), "초록 gzip ", megabytes(total), " — 기관별로 쪼갤 때다"), _said(unjudged.isNull(), "판정 기록 없음"), _said(unjudged.isNotNull() & (m["recommend"]["error"] != ""), "판정 실패: ", m["recommend"]["error"]), _said(unjudged > 0, "미판정 ", _number(unjudged), "건"),
    ]
    return ran & m["boards"].isNotNull() & m["reports"].isNotNull(), figures, warnings


def domain_states(manifests: DataFrame, now: Column) -> DataFrame:
    """Manifests (domain, body JSON), each read by its domain's own shape: reason (null: readable), run_at, hours,
    figures (label, value) and warnings, oldest run first said. A body that is null couldn't be fetched; one that
    hasn't the shape changed it; neither counts as zeros. Domains without a shape are left out."""
    made = None
    for domain, (at, shape) in _SHAPES.items():
        rows = manifests.where(F.col("domain") == domain).withColumn("m", F.from_json("body", shape))
        readable, figures, warnings = _adapted(domain, F.col("m"))
        readable = F.coalesce(readable, F.lit(False))
        run_at = F.when(readable, F.col("m")[at])
        hours = F.when(readable, elapsed_hours(F.try_to_timestamp(run_at), now))
        reason = F.when(F.col("body").isNull(), "불러오지 못함").when(~readable, "형식을 못 읽음")
        late = _said(hours >= _TOO_LONG, hours.cast("string"), "시간째 안 돌았다")
        present = lambda xs: F.when(readable, F.filter(F.array(*xs), lambda x: x.isNotNull()))
        own = rows.withColumns({"reason": reason, "run_at": run_at, "hours": hours, "figures": present(figures), "warnings": present([late, *warnings])}).drop("m", "body")
        made = own if made is None else made.unionByName(own)
    return made
