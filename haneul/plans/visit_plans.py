"""Web-visit plans: the statistics of a window, and the scalar functions of a visit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import visits
from . import views
from .registry import Registry

R = Registry(views.VIEWS)
HIT = ("hit0", "hit1", "owner", "hit")
WINDOW, BEFORE = visits.window_of(views.TODAY_HITS, 7)
_IN, _PREV = f"day BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}'", f"day BETWEEN '{BEFORE[0]}' AND '{BEFORE[1]}'"


@R.add("g01_visit_summary", f"SELECT count(DISTINCT visitor) AS visitors, count(DISTINCT session) AS sessions, count(*) AS views FROM hit WHERE {_IN}", HIT)
def _(spark, sf):
    return visits.summary(visits.within(views.guests(spark, sf), WINDOW))


@R.add("g02_new_and_returning", f"""SELECT count(*) FILTER (WHERE first_day BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}') AS new_visitors, count(*) FILTER (WHERE sessions > CASE WHEN first_day BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}' THEN 1 ELSE 0 END) AS returning_visitors
    FROM (SELECT visitor, count(DISTINCT session) AS sessions FROM hit WHERE {_IN} GROUP BY 1) JOIN (SELECT visitor, min(day) AS first_day FROM hit GROUP BY 1) USING (visitor)""", HIT)
def _(spark, sf):
    return visits.new_and_returning(views.guests(spark, sf), WINDOW)


@R.add("g03_visits_by_domain", f"SELECT domain, count(DISTINCT visitor) AS visitors, count(DISTINCT session) AS sessions, count(*) AS views FROM hit WHERE {_IN} GROUP BY 1", HIT)
def by_domain(spark, sf):
    return visits.by_domain(visits.within(views.guests(spark, sf), WINDOW))


@R.add("g04_returning_by_domain", f"SELECT h.domain, count(DISTINCT h.visitor) AS returning FROM hit h JOIN (SELECT visitor, arg_min(session, id) AS first_session FROM hit GROUP BY 1) f USING (visitor) WHERE {_IN} AND h.session <> first_session GROUP BY 1", HIT)
def _(spark, sf):
    return visits.returning_by_domain(views.guests(spark, sf), WINDOW)


@R.add("g05_daily_views", "SELECT day, domain, count(*) AS views, count(DISTINCT visitor) AS visitors FROM hit GROUP BY GROUPING SETS ((day, domain), (day))", HIT)
def _(spark, sf):
    return visits.daily(views.guests(spark, sf))


@R.add("g06_top_screens", "SELECT domain, path, count(*) AS views, count(DISTINCT visitor) AS visitors FROM hit GROUP BY 1, 2 ORDER BY views DESC, domain, path LIMIT 20", HIT)
def _(spark, sf):
    return visits.top_screens(views.guests(spark, sf), 20)


_TOUCH = f"(SELECT session, arg_min(struct_pack(r := ref, k := ref_kind), id) AS f FROM hit WHERE {_IN} GROUP BY 1)"


@R.add("g07_first_touch_kinds", f"SELECT f.k AS ref_kind, count(*) AS sessions FROM {_TOUCH} GROUP BY 1", HIT)
def _(spark, sf):
    return visits.first_touch(visits.within(views.guests(spark, sf), WINDOW)).groupBy("ref_kind").agg(F.count("*").alias("sessions"))


@R.add("g07_first_touch_referrers", f"SELECT f.r AS ref, count(*) AS sessions FROM {_TOUCH} WHERE f.r IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HIT)
def _(spark, sf):
    return visits.first_touch(visits.within(views.guests(spark, sf), WINDOW)).where("ref is not null").groupBy("ref").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "ref").limit(10)


for _c in ("device", "mode", "ref"):

    @R.add(f"g08_visitors_by_{_c}", f"SELECT {_c}, count(DISTINCT visitor) AS visitors FROM hit WHERE {_IN} AND {_c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HIT)
    def _(spark, sf, c=_c):
        return visits.distribution(visits.within(views.guests(spark, sf), WINDOW), c, 10)


_COMPARED = f"(SELECT domain, count(*) FILTER (WHERE {_IN}) AS views, count(DISTINCT visitor) FILTER (WHERE {_IN}) AS visitors, count(*) FILTER (WHERE {_PREV}) AS prev_views, count(DISTINCT visitor) FILTER (WHERE {_PREV}) AS prev_visitors FROM hit GROUP BY 1 HAVING views > 0)"


@R.add("g09_previous_window", f"SELECT * FROM {_COMPARED}", HIT)
def compared(spark, sf):
    return visits.compare_windows(views.guests(spark, sf), WINDOW, BEFORE)


@R.add("g10_daily_assembly", """SELECT day, string_agg(domain || '=' || CAST(views AS VARCHAR), ',' ORDER BY domain) AS by_domain, max(visitors) AS visitors FROM (
    SELECT a.day, a.domain, a.views, b.visitors FROM (SELECT day, domain, count(*) AS views FROM hit GROUP BY 1, 2) a JOIN (SELECT day, count(DISTINCT visitor) AS visitors FROM hit GROUP BY 1) b USING (day)) GROUP BY 1""", HIT)
def _(spark, sf):
    entries = F.transform(F.map_entries("by_domain"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return visits.daily_assembled(views.guests(spark, sf)).select("day", F.array_join(entries, ",").alias("by_domain"), "visitors")


@R.add("h09_day_fill", f"""SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(views, 0) AS views, coalesce(visitors, 0) AS visitors FROM
    (SELECT unnest(generate_series(CAST(greatest('2023-12-25', (SELECT min(day) FROM hit)) AS TIMESTAMP), TIMESTAMP '{views.TODAY_HITS}', INTERVAL 1 DAY)) AS d) LEFT JOIN
    (SELECT day, count(*) AS views, count(DISTINCT visitor) AS visitors FROM hit GROUP BY 1) h ON h.day = strftime(d, '%Y-%m-%d')""", HIT)
def _(spark, sf):
    rows = views.guests(spark, sf).groupBy("day").agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))
    return visits.fill_days(rows, ("2023-12-25", views.TODAY_HITS), ["views", "visitors"])


@R.add("k46_change_percent", f"SELECT domain, CASE WHEN prev_views <> 0 THEN CAST(floor((views - prev_views) * 100.0 / prev_views + 0.5) AS BIGINT) END AS change, CASE WHEN views > prev_views THEN 'up' WHEN views < prev_views THEN 'down' ELSE 'flat' END AS direction FROM {_COMPARED}", HIT)
def _(spark, sf):
    c = compared(spark, sf)
    return c.select("domain", numbers.change_percent(F.col("views"), F.col("prev_views")).alias("change"), numbers.direction(F.col("views") - F.col("prev_views")).alias("direction"))


@R.add("k47_share_of_views", f"SELECT domain, floor(views * 1000.0 / sum(views) OVER () + 0.5) / 10 AS share FROM (SELECT domain, count(*) AS views FROM hit WHERE {_IN} GROUP BY 1)", HIT)
def _(spark, sf):
    rows = by_domain(spark, sf)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("views").alias("all")))).select("domain", numbers.share_1(F.col("views"), F.col("all")).alias("share"))  # one row


@R.add("e12_owner_exclusion", "SELECT domain, count(*) AS views FROM hit GROUP BY 1", HIT)
def _(spark, sf):
    return visits.without_owners(views.raw_hits(spark, sf), views.owners(spark, sf)).groupBy("domain").agg(F.count("*").alias("views"))


@R.add("o02_daily_cap", "SELECT visitor, day, count(*) AS hits, count(*) FILTER (WHERE k <= 3) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY visitor, day ORDER BY ts, id) AS k FROM hit0) GROUP BY 1, 2", ("hit0",))
def _(spark, sf):
    hits = views.raw_hits(spark, sf)
    kept = visits.capped(hits, 3).groupBy("visitor", "day").agg(F.count("*").alias("kept"))
    return hits.groupBy("visitor", "day").agg(F.count("*").alias("hits")).join(kept, ["visitor", "day"])


@R.add("o03_visitor_summary", "SELECT visitor, min(day) AS first_day, max(day) AS last_day, count(*) AS hits, arg_min(session, id) AS first_session FROM hit1 GROUP BY 1", ("hit0", "hit1"))
def _(spark, sf):
    return visits.visitors(views.hits(spark, sf))


@R.add("o05_without_repeats", "SELECT domain, count(*) AS views FROM (SELECT *, lag(domain) OVER (PARTITION BY session ORDER BY ts, id) AS p FROM hit) WHERE p IS NULL OR p <> domain GROUP BY 1", HIT)
def _(spark, sf):
    hits = views.guests(spark, sf).withColumn("path", F.col("domain"))
    return visits.without_repeats(hits).groupBy("domain").agg(F.count("*").alias("views"))


@R.add("o06_session_windows", "SELECT visitor, count(*) AS sessions, max(views) AS longest FROM (SELECT visitor, session, count(*) AS views FROM hit1 GROUP BY 1, 2) GROUP BY 1", ("hit0", "hit1"))
def _(spark, sf):
    return visits.session_windows(views.raw_hits(spark, sf)).groupBy("visitor").agg(F.count("*").alias("sessions"), F.max("views").alias("longest"))


@R.add("o07_day_windows", "SELECT day, domain, count(*) AS views FROM hit0 GROUP BY 1, 2", ("hit0",))
def _(spark, sf):
    return visits.day_windows(views.raw_hits(spark, sf))


@R.add("k10_page_hosts", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@R.add("k11_referrer_kind", "SELECT ref_kind, count(*) AS n FROM hit0 GROUP BY 1", ("hit0",))
def _(spark, sf):
    return views.raw_hits(spark, sf).groupBy("ref_kind").agg(F.count("*").alias("n"))


@R.add("k12_device", "SELECT device, count(*) AS n FROM hit0 GROUP BY 1", ("hit0",))
def _(spark, sf):
    return views.raw_hits(spark, sf).groupBy("device").agg(F.count("*").alias("n"))


@R.add("k13_page_path", r"""SELECT page_id, '/' || coalesce(array_to_string(list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda s: s <> '')[1:4], lambda s: CASE WHEN contains(s, '=') THEN split_part(s, '=', 1) || '=:id' WHEN regexp_matches(s, '[0-9]') THEN ':id' ELSE s END), '/'), '') AS path FROM pages""")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.page_path(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("path"))


@R.add("e10_bot_filter", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(r, '(?i)bot|crawl|spider|slurp|headless|preview|monitor|curl|wget|python') OR r IS NULL OR r = '') AS bots FROM (SELECT ref AS r FROM hit0)", ("hit0",))
def _(spark, sf):
    return views.raw_hits(spark, sf).agg(F.count("*").alias("n"), F.count_if(text.is_bot(F.col("ref"))).alias("bots"))


@R.add("k41_local_day", "SELECT day, count(*) AS n FROM hit0 GROUP BY 1", ("hit0",))
def _(spark, sf):
    return views.raw_hits(spark, sf).groupBy("day").agg(F.count("*").alias("n"))


@R.add("g05_cube_of_measures", f"SELECT domain, device, mode, count(*) AS views FROM hit WHERE {_IN} GROUP BY CUBE (domain, device, mode)", HIT)
def _(spark, sf):
    return visits.within(views.guests(spark, sf), WINDOW).cube("domain", "device", "mode").agg(F.count("*").alias("views"))
