"""Smaller plans: joins to dimensions, overlays, labels, and scalar functions of rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, numbers, printed, text
from ..functions.dealing import dealt
from ..operators import ask, documents, forecasts, planner, press, quality, series, status, versioning
from ..operators import printed as printed_ops
from . import views
from .document_plans import R as DOCUMENTS
from .document_plans import _cand, _score
from .registry import Registry

R = Registry(DOCUMENTS.views)
T = views.table


@R.add("a08_parameterised_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1")
def _(spark, sf):
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY 1", args={"status": "F", "least": 100000}, orders=T(spark, sf, "orders"))


@R.add("b13_partial_run", "SELECT event_type AS name, count(*) AS rows FROM events WHERE event_type <> 'click' OR value > 10 GROUP BY 1")
def _(spark, sf):
    e = T(spark, sf, "events").withColumnRenamed("event_type", "name")
    counts = lambda d: d.groupBy("name").agg(F.count("*").alias("rows"))
    return versioning.replace_run(counts(e), counts(e.where("name = 'click' and value > 10")), "name")


@R.add("c12_additive_identity", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE abs(l_extendedprice - round(l_extendedprice * (1 - l_discount), 0) - round(l_extendedprice * l_discount, 0)) > 0.5")
def _(spark, sf):
    whole, cut = F.col("l_extendedprice"), F.col("l_discount")
    rules = {"sum": F.abs(whole - F.round(whole * (1 - cut), 0) - F.round(whole * cut, 0)) <= 0.5}
    return quality.judge(T(spark, sf, "lineitem"), rules).where(F.size("failed") > 0).select("l_orderkey", "l_linenumber", "l_partkey")


@R.add("c13_quotient_identity", "SELECT p_partkey, abs(p_retailprice / p_size - round(p_retailprice / p_size, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END)) <= 0.01 AS fits FROM part")
def _(spark, sf):
    q = F.col("p_retailprice") / F.col("p_size")
    return T(spark, sf, "part").select("p_partkey", quality.quotient_fits(F.col("p_retailprice"), F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 2 == 0, F.round(q, 3)).otherwise(F.round(q, 0))).alias("fits"))


@R.add("d06_report_upsert", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM documents WHERE source <> 'src9' UNION ALL SELECT doc_id, 'added' FROM documents WHERE source = 'src9'")
def _(spark, sf):
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars", "source", F.lit("2024-01-01").alias("collected"))
    new = d.withColumns({"n_chars": F.col("n_chars") + F.when(F.col("id") % 2 == 0, 1).otherwise(0), "collected": F.lit("2024-02-01")})
    return versioning.upsert(d.where("source <> 'src9'"), new, "id", "collected", ["text", "n_chars", "source"]).select("id", "action")


@R.add("d09_relinked", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'landing' END, 'old') AS url, CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN l.quality = 1 AND l.toxic = 1 THEN 'pair' WHEN l.quality = 1 THEN 'url' ELSE 'none' END AS how FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    rows = T(spark, sf, "documents").select("doc_id", F.lit("o").alias("org"), F.col("doc_id").cast("string").alias("title"), F.lit("old").alias("url"))
    resolved = T(spark, sf, "labels").select(F.lit("o").alias("org"), F.col("doc_id").cast("string").alias("title"), F.when(F.col("quality") == 1, "landing").alias("landing"), F.when(F.col("toxic") == 1, "file").alias("file"))
    return status.relinked(rows, resolved).select("doc_id", "url", "how")


@R.add("d11_carried_verdicts", "SELECT d.doc_id, l.quality, 'v2' AS version, 'v1' AS carried_from FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND d.lang = 'en'")
def _(spark, sf):
    plan = T(spark, sf, "documents").join(T(spark, sf, "labels").where("toxic = 1"), "doc_id").where("lang = 'en'")
    return versioning.carried(plan.select("doc_id", "quality", F.lit("v1").alias("version")), "v2")


@R.add("d14_owner_insert", "SELECT DISTINCT visitor FROM owner UNION SELECT user_id FROM events WHERE event_type = 'signup' AND value < 1", ("owner",))
def _(spark, sf):
    new = T(spark, sf, "events").where("event_type = 'signup' and value < 1").select(F.col("user_id").alias("visitor"), F.col("event_id").alias("o"))
    stored = views.owners(spark, sf)
    return stored.unionByName(versioning.insert_absent(stored, new, ["visitor"], "o").select("visitor"))


@R.add("d15_refreshed", "SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'new' ELSE 'old' END AS text FROM labels")
def _(spark, sf):
    l = T(spark, sf, "labels")
    return versioning.refreshed(l.select("doc_id", F.lit("old").alias("text")), l.where("toxic = 1").select("doc_id", F.when(F.col("quality") == 1, "new").alias("text")), "doc_id")


@R.add("e06_relevant", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'orantion|thatin|hehely')")
def _(spark, sf):
    return T(spark, sf, "documents").where(press.relevant(F.col("text"), ["orantion", "thatin", "hehely"])).select("doc_id")


@R.add("e07_relevant_follow", "SELECT doc_id FROM documents WHERE contains(text, 'hehely') OR contains(text, 'orantion') AND contains(text, 'thatin')")
def _(spark, sf):
    return T(spark, sf, "documents").where(press.relevant_follow(F.col("text"), ["hehely"], ["orantion"], ["thatin"])).select("doc_id")


@R.add("f07_grouped_rationales", "SELECT org, published, count(*) AS n, string_agg(indicator, ',' ORDER BY ord) AS indicators FROM forecast GROUP BY 1, 2", ("forecast",))
def _(spark, sf):
    return forecasts.grouped_reports(views.forecasts(spark, sf), ["org", "published"])


@R.add("f14_release_overlay", "SELECT DISTINCT o.source, o.period, coalesce(r.url, 'board/' || o.source) AS url FROM observation o LEFT JOIN (SELECT o_orderstatus AS s, strftime(o_orderdate, '%Y-%m') AS m, 'post/' || CAST(min(o_orderkey) AS VARCHAR) AS url FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2) r ON r.s = o.source AND r.m = o.period", ("observation",))
def _(spark, sf):
    posts = T(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderstatus").alias("source"), dates.month_of(F.col("o_orderdate")).alias("period")).agg(F.concat(F.lit("post/"), F.min("o_orderkey").cast("string")).alias("url"))
    periods = views.observations(spark, sf).select("source", "period").distinct()
    return series.with_releases(periods, posts, ["source", "period"], F.concat(F.lit("board/"), "source"))


@R.add("f20_short_names", "SELECT s_suppkey, coalesce(CASE WHEN n_nationkey < 10 THEN substr(n_name, 1, 3) END, n_name) AS shown FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    n = T(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") < 10, F.substring("n_name", 1, 3)).alias("short"))
    return series.shown_names(T(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey", "n_nationkey").select("s_suppkey", "shown")


@R.add("f23_squashed_names", "SELECT p_partkey, q.k FROM part p LEFT JOIN (SELECT replace(p_name, ' ', '') AS n, min(p_partkey) AS k FROM part GROUP BY 1) q ON q.n = replace(p.p_name, ' ', '')")
def _(spark, sf):
    p = T(spark, sf, "part")
    codes = p.groupBy(text.squash(F.col("p_name")).alias("n")).agg(F.min("p_partkey").alias("k"))
    return p.withColumn("n", text.squash(F.col("p_name"))).join(codes, "n", "left").select("p_partkey", "k")


@R.add("i10_numbers_in_order", "SELECT org, string_agg(CAST(year AS VARCHAR) || half, ',' ORDER BY year, CASE half WHEN 'annual' THEN 0 WHEN 'h1' THEN 1 ELSE 2 END) AS shown FROM (SELECT DISTINCT org, year, half FROM forecast) GROUP BY 1", ("forecast",))
def _(spark, sf):
    return forecasts.targets_in_order(views.forecasts(spark, sf), ["org"])


@R.add("j06_badges", "SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'pick' END, CASE WHEN toxic = 1 THEN 'care' END) AS badges FROM labels")
def _(spark, sf):
    flags = press.badges({"pick": F.col("quality") == 1, "care": F.col("toxic") == 1})
    return T(spark, sf, "labels").select("doc_id", F.array_join(flags, ",").alias("badges"))


@R.add("j09_shared_periods", "SELECT period FROM observation WHERE source = 'F' INTERSECT SELECT period FROM observation WHERE source = 'P'", ("observation",))
def _(spark, sf):
    return series.shared_periods(views.observations(spark, sf), "F", "P")


@R.add("k16_trend_name", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'SALE' ELSE p_type END AS name FROM part")
def _(spark, sf):
    return T(spark, sf, "part").select("p_partkey", printed.trend_name(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")), {"PROMO": "SALE"}).alias("name"))


@R.add("k24_period_of_title", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def _(spark, sf):
    title = F.concat(F.lit("고용동향('"), F.date_format("o_orderdate", "yy년 M월"), F.lit(")"))
    return T(spark, sf, "orders").select("o_orderkey", F.when(F.year("o_orderdate") < 2000, F.concat(F.lit("19"), F.substring(printed.period_of_title(title), 3, 5))).otherwise(printed.period_of_title(title)).alias("period"))


@R.add("k26_row_figures", "SELECT o_orderkey, round(o_totalprice, 2) AS a, -CAST(o_custkey AS DOUBLE) AS b, '합계' AS label FROM orders")
def _(spark, sf):
    line = F.concat(F.lit("합계(천명) "), F.format_number("o_totalprice", 2), F.lit(" △"), F.col("o_custkey").cast("string"), F.lit(" [3.0]"))
    f = printed.row_figures(line)
    return T(spark, sf, "orders").select("o_orderkey", F.round(f[0], 2).alias("a"), f[1].alias("b"), printed.row_label(line).alias("label"))


@R.add("k43_year_prefix", "SELECT doc_id, CAST(published[1:4] AS INT) AS year FROM report", ("report",))
def _(spark, sf):
    return views.reports(spark, sf).select("doc_id", text.year_prefix(F.col("published")).alias("year"))


@R.add("k50_delta_tone", "SELECT ord, CASE WHEN d IS NULL THEN NULL WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END AS tone FROM (SELECT ord, round(value - lag(value) OVER (PARTITION BY org, indicator, year, half ORDER BY published, ord), 2) AS d FROM forecast)", ("forecast",))
def _(spark, sf):
    chain = forecasts.revision_chain(views.forecasts(spark, sf), ["org", "indicator", "year", "half"])
    return chain.select("ord", numbers.direction(F.col("revision")).alias("tone"))


@R.add("k52_headline_change", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST((o_custkey // 10) * 10 + o_custkey % 10 AS DOUBLE) AS n FROM orders")
def _(spark, sf):
    k = F.col("o_custkey")
    said = F.concat(F.floor(k / 10).cast("string"), F.lit("만 "), (k % 10).cast("string"), F.lit("천명 "), F.when(F.col("o_orderkey") % 2 == 0, "증가").otherwise("감소"))
    return T(spark, sf, "orders").select("o_orderkey", printed.headline_change(said).alias("n"))


@R.add("k60_json_or_empty", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n FROM events")
def _(spark, sf):
    body = F.when(F.col("event_id") % 3 == 0, "not json").otherwise('["a", "b"]')
    return T(spark, sf, "events").select("event_id", F.size(text.json_list(body)).alias("n"))


@R.add("k65_row_json", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || CAST(n_regionkey AS VARCHAR) || '}' AS j FROM nation")
def _(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", text.row_json("n_name", "n_regionkey").alias("j"))


@R.add("k66_split_hits", "SELECT event_id, event_type AS axis, 'k:' || json_extract_string(props, '$.k') AS name FROM events")
def _(spark, sf):
    hit = F.concat_ws(":", F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return T(spark, sf, "events").select("event_id", text.split_hit(hit).alias("x")).select("event_id", "x.axis", "x.name")


@R.add("m07_evidence_rows", "SELECT source, period, CASE WHEN source = 'F' THEN value END AS value, CASE WHEN source = 'F' THEN '수준' ELSE '증감률만' END AS basis FROM observation WHERE series = 'headcount' AND breakdown = 'total'", ("observation",))
def _(spark, sf):
    o = views.observations(spark, sf).where("series = 'headcount' and breakdown = 'total'")
    basis = spark.createDataFrame([("F", "수준"), ("O", "증감률만")], "source string, basis string")
    return ask.evidence_rows(o, basis).select("source", "period", "value", "basis")


@R.add("m08_allowed_figures", "SELECT org, indicator, count(DISTINCT v) AS n, max(v) AS most FROM (SELECT org, indicator, value AS v FROM forecast UNION ALL SELECT org, indicator, abs(round(value - lag(value) OVER (PARTITION BY org, indicator, year, half ORDER BY published, ord), 2)) FROM forecast UNION ALL SELECT org, indicator, round(value - lag(value) OVER (PARTITION BY org, indicator, year, half ORDER BY published, ord), 2) FROM forecast) WHERE v IS NOT NULL GROUP BY 1, 2", ("forecast",))
def _(spark, sf):
    chain = forecasts.revision_chain(views.forecasts(spark, sf), ["org", "indicator", "year", "half"])
    made = ask.allowed_figures(chain, ["org", "indicator"], ["value", "revision"])
    return made.select("org", "indicator", F.size("allowed").cast("long").alias("n"), F.array_max("allowed").alias("most"))


@R.add("m12_phenomenon", "SELECT c_custkey AS q, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' ELSE 'any' END AS phenomenon FROM customer")
def _(spark, sf):
    q = T(spark, sf, "customer").select(F.col("c_custkey").alias("q"), F.create_map(F.lit("segment"), F.lit("x")).alias("asked"), F.lower("c_mktsegment").alias("text"))
    p = spark.createDataFrame([(1, "b", {"segment": "x"}, ["build"]), (2, "no", {"segment": "y"}, ["a"]), (3, "any", {"segment": "x", "more": "z"}, ["i", "o", "e"])], "ord int, id string, axes map<string,string>, words array<string>")
    return ask.phenomenon(q, p)


@R.add("m03_kind_of_question", "SELECT event_id, CASE WHEN event_type = 'view' AND value >= 5 THEN 'numeric' WHEN event_type = 'click' AND value >= 5 THEN 'cause' ELSE 'outside' END AS kind FROM events")
def _(spark, sf):
    raw = F.when(F.col("event_type") == "view", "numeric").when(F.col("event_type") == "click", "cause").otherwise(F.col("event_type"))
    return T(spark, sf, "events").select("event_id", ask.kind_of(raw, F.col("value") / 10).alias("kind"))


_DICTIONARY = ask.Dictionary({"주문": "orders"}, {"priority": {"긴급": "1-URGENT"}}, {"orders": [("F", "headcount"), ("O", "headcount")]}, [["orantion", "thatin"]])


@R.add("m05_observe", "SELECT source, series, breakdown, category, period, value FROM observation WHERE series = 'headcount' AND source IN ('F', 'O') AND breakdown = 'priority' AND category = '1-URGENT' AND period = '1998-03'", ("observation",))
def _(spark, sf):
    slots = ask.slots_of(spark, "1998년 3월 긴급 주문은?", _DICTIONARY, "2001-08-15")
    return ask.observe(views.observations(spark, sf), slots, _DICTIONARY)


_ASKED_ORDERS = "(SELECT * FROM observation WHERE series = 'headcount' AND source IN ('F', 'O') AND breakdown = 'priority' AND category = '1-URGENT')"
_LAST_13 = f"(SELECT * FROM {_ASKED_ORDERS} o WHERE (CAST(period[1:4] AS INT) * 12 + CAST(period[6:7] AS INT)) > (SELECT max(CAST(period[1:4] AS INT) * 12 + CAST(period[6:7] AS INT)) - 13 FROM {_ASKED_ORDERS} i WHERE i.source = o.source AND i.series = o.series))"
_SHAPED = f"(SELECT source, series, count(*) AS n, count(DISTINCT period) AS p, sum(value) AS total, arg_min(value, period) AS f, arg_max(value, period) AS l FROM {_LAST_13} GROUP BY 1, 2)"
_HITS = "(SELECT domain, doc_id, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, date DESC NULLS LAST, doc_id) AS INT) AS place, score FROM (SELECT domain, doc_id, date, " + _score(["주문", "hehely", "긴급"]) + " AS score FROM corpus WHERE " + _cand(["긴급", "주문", "hehely"]) + ") QUALIFY place <= 5)"


@R.add("m15_lookup", f"""SELECT 'figures' AS part, 'figures' AS domain, concat_ws(':', source, series, category, period) AS item, CAST(NULL AS INT) AS place, value FROM {_LAST_13}
    UNION ALL SELECT 'derived', 'figures', concat_ws(':', source, series, CASE WHEN p = 1 AND n > 1 THEN 'cross-section' WHEN p > 1 AND p = n THEN 'time-series' ELSE 'mixed' END), NULL, CASE WHEN p = 1 AND n > 1 THEN total WHEN p > 1 AND p = n THEN l - f END FROM {_SHAPED}
    UNION ALL SELECT 'documents', domain, doc_id, place, CAST(score AS DOUBLE) FROM {_HITS} UNION ALL SELECT 'domains', domain, NULL, NULL, CAST(max(score) AS DOUBLE) FROM {_HITS} GROUP BY domain""", ("observation", "report", "corpus"))
def _(spark, sf):
    from .document_plans import corpus

    slots = ask.slots_of(spark, "긴급 주문 hehely", _DICTIONARY, "2001-08-15")
    return ask.found_of(ask.lookup(views.observations(spark, sf), corpus(spark, sf), slots, _DICTIONARY))


def _catalogue(spark, sf):
    """Suppliers as sources, of which those in debt are unconfirmed; nations limit and separate them."""
    s = T(spark, sf, "supplier")
    sources = s.select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_acctbal") >= 0).alias("confirmed"), (F.col("s_nationkey") < 12).alias("archived"))
    limits = s.where("s_acctbal > 5000").select(F.concat(F.lit("L"), "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("source"))
    other = s.select(F.col("s_suppkey").alias("k2"), F.col("s_nationkey").alias("s_nationkey"))
    pairs = s.join(other, "s_nationkey").where("s_suppkey + 1 = k2")
    conflicts = pairs.select(F.concat(F.lit("C"), "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("source_a"), F.col("k2").cast("string").alias("source_b"), F.lit("증감률만").alias("level"), F.lit("개념").alias("kind"))
    return sources, limits, conflicts


_META = """SELECT part, id FROM (SELECT CASE WHEN s_acctbal >= 0 THEN 'source' ELSE 'unconfirmed' END AS part, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE {x}
    UNION ALL SELECT 'limit', 'L' || s_suppkey FROM supplier WHERE s_acctbal > 5000 AND {x} UNION ALL SELECT 'conflict', 'C' || a.s_suppkey FROM (SELECT * FROM supplier WHERE {x}) a JOIN (SELECT * FROM supplier WHERE {x}) b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey + 1 = b.s_suppkey)"""


@R.add("m17_meta", _META.format(x="s_nationkey BETWEEN 5 AND 9"))
def _(spark, sf):
    ids = T(spark, sf, "supplier").where("s_nationkey between 5 and 9").select(F.col("s_suppkey").cast("string").alias("id"))
    return planner.meta(*_catalogue(spark, sf), ids)


@R.add("e18_archived_sources", _META.format(x="s_nationkey < 12"))
def _(spark, sf):
    return planner.meta(*_catalogue(spark, sf))


@R.add("g32_derived_conflicts", """SELECT 'CONF-' || a.r_name || '-' || b.r_name || '-' || k.kind AS id, a.r_name AS source_a, b.r_name AS source_b, k.kind, CASE k.kind WHEN '개념' THEN a.r_name || '는 ' || lower(a.r_name) || ', ' || b.r_name || '는 ' || lower(b.r_name) || '로 개념이 다르다' ELSE 'all of ' || a.r_regionkey || ' vs all of ' || b.r_regionkey END AS text, '증감률만' AS level
    FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey, (VALUES ('개념'), ('모집단')) k(kind)""")
def _(spark, sf):
    r = T(spark, sf, "region")
    sources = r.select(F.col("r_name").alias("code"), F.col("r_name").alias("name"), F.lower("r_name").alias("headline"), F.concat(F.lit("all of "), "r_regionkey").alias("coverage"))
    pairs = r.select(F.col("r_name").alias("a"), (F.col("r_regionkey") + 1).alias("k")).join(r.select(F.col("r_name").alias("b"), F.col("r_regionkey").alias("k")), "k").select("a", "b")
    return planner.derive_conflicts(sources, pairs)


@R.add("j08_plan_narrow", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unjudged' WHEN l.toxic = 1 THEN 'keep' WHEN l.quality = 1 THEN 'ask' ELSE 'carry' END AS plan FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    cache = T(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "v2").otherwise("v1").alias("version"), (F.col("quality") == 1).alias("pick"))
    return versioning.plan_narrow(T(spark, sf, "documents").select("doc_id"), cache, "doc_id", "v2").select("doc_id", "plan")


@R.add("i09_default_order", "SELECT doc_id, published FROM report ORDER BY published DESC, doc_id DESC", ("report",))
def _(spark, sf):
    return documents.default_order(views.reports(spark, sf).select("doc_id", "published"))


@R.add("k63_json_leaves", "SELECT event_id, [event_type] AS texts, [CAST(json_extract_string(props, '$.k') AS DOUBLE), value] AS figures FROM events")
def _(spark, sf):
    made = F.to_json(F.struct(F.struct("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("a"), F.array(F.struct("value", F.lit("").alias("none"))).alias("b")))
    return T(spark, sf, "events").select("event_id", text.json_leaves(made).alias("x")).select("event_id", "x.texts", "x.figures")


@R.add("c24_tables_in_order", """SELECT o_orderkey, level_tab, level, delta_tab, delta, rate_tab, rate, CASE WHEN delta_tab IS NULL THEN 'too few' WHEN level < 20 THEN 'level' WHEN abs(delta) >= 45 THEN 'change' WHEN rate_tab IS NOT NULL AND coalesce(abs(delta * 100 / nullif(level - delta, 0) - rate) > greatest(0.5, abs(rate) * 0.25), true) THEN 'order' END AS problem FROM (
    SELECT l_orderkey AS o_orderkey, max(CASE WHEN k = 1 THEN l_linenumber END) AS level_tab, max(CASE WHEN k = 1 THEN l_quantity END) AS level, max(CASE WHEN k = 2 THEN l_linenumber END) AS delta_tab, max(CASE WHEN k = 2 THEN l_quantity END) AS delta, max(CASE WHEN k = 3 THEN l_linenumber END) AS rate_tab, max(CASE WHEN k = 3 THEN l_quantity END) AS rate
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) GROUP BY 1)""")
def _(spark, sf):
    order, lines = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"), T(spark, sf, "lineitem")
    tables = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), lines.count(), "l_orderkey").withColumn("k", F.row_number().over(order)).select(F.col("l_orderkey").alias("o_orderkey"), F.struct("k", F.col("l_linenumber").alias("n")).alias("tab"), F.col("l_quantity").alias("value"))
    found = quality.tables_in_order(tables, ["o_orderkey"], 20, 45)
    return found.withColumns({f"{n}_tab": F.col(f"{n}_tab.n") for n in ("level", "delta", "rate")})


@R.add("k23_quoted_on_page", r"""SELECT q.doc_id, q.quote, q.hint, arg_min(p.page, (p.page <> q.hint, p.page)) AS page FROM (SELECT doc_id, 'the' AS quote, 2 AS hint FROM documents) q LEFT JOIN
    (SELECT doc_id, CAST(unnest(generate_series(1, len(pages))) AS INT) AS page, unnest(pages) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)) p ON p.doc_id = q.doc_id AND regexp_matches(p.text, '(^|[^\p{L}\p{N}])the') GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = T(spark, sf, "documents")
    pages = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")
    return printed_ops.quoted_on_page(d.select("doc_id", F.lit("the").alias("quote"), F.lit(2).alias("hint")), pages, ["doc_id"])


@R.add("k36_unfolded_header", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Table' || chr(10) || '2024 2025 2025' || chr(10) || '연간 상반기 수정폭1)' || chr(10) || c_name ELSE 'Table' || chr(10) || '2025' || chr(10) || '2024 2025' || chr(10) || CASE c_custkey % 3 WHEN 1 THEN '수정' ELSE '수정폭1) 2' END || chr(10) || '연간 상반기 연간' || chr(10) || c_name END AS header FROM customer")
def _(spark, sf):
    mark = F.element_at(F.array(F.lit("수정폭1)"), F.lit("수정"), F.lit("수정폭1) 2")), (F.col("c_custkey") % 3 + 1).cast("int"))
    folded = F.concat(F.lit("Table\n2025\n2024 2025\n"), mark, F.lit("\n연간 상반기 연간\n"), "c_name")
    return T(spark, sf, "customer").select("c_custkey", printed_ops.unfolded_header(folded).alias("header"))


_KEYS = ["org", "indicator", "year", "half"]
_LATE = "(SELECT * FROM forecast f WHERE value <= 40 AND published >= '1996-01-01' AND NOT EXISTS (SELECT 1 FROM forecast s WHERE s.value > 40 AND s.org = f.org AND s.indicator = f.indicator AND s.year = f.year AND s.half = f.half AND s.published = f.published) QUALIFY row_number() OVER (PARTITION BY org, indicator, year, half, published ORDER BY ord) = 1)"


@R.add("a28_backfill", f"SELECT *, round(value - prev_value, 2) AS revision FROM (SELECT *, lag(value) OVER (PARTITION BY org, indicator, year, half ORDER BY published, ord) AS prev_value FROM (SELECT * FROM forecast WHERE value > 40 UNION ALL SELECT * FROM {_LATE}))", ("forecast",))
def _(spark, sf):
    f = views.forecasts(spark, sf)
    return forecasts.backfill(f.where("value > 40"), f.where("value <= 40"), "1996-01-01", _KEYS)[0]


@R.add("a28_backfilled_rounds", f"SELECT r.org, r.published, count(l.ord) AS added FROM (SELECT DISTINCT org, published FROM forecast WHERE value <= 40 AND published >= '1996-01-01') r LEFT JOIN {_LATE} l USING (org, published) GROUP BY 1, 2", ("forecast",))
def _(spark, sf):
    f = views.forecasts(spark, sf)
    return forecasts.backfill(f.where("value > 40"), f.where("value <= 40"), "1996-01-01", _KEYS)[1]


@R.add("a22f_newest_supplement", """SELECT * FROM (SELECT source, strftime(d, '%Y-%m') AS period, 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(d, '%Y-%m-%d') END AS released, CASE WHEN o_orderkey % 4 <> 0 THEN 'f' || o_orderkey END AS file FROM (
    SELECT o_custkey AS source, o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND strftime(d, '%Y-%m') > '1998-01') WHERE released IS NOT NULL AND file IS NOT NULL""")
def _(spark, sf):
    o = T(spark, sf, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    files = F.array(F.struct(F.when(key % 4 == 0, "pdf").otherwise("hwpx").alias("type"), F.concat(F.lit("f"), key).alias("url")))
    newest = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    posts = o.withColumn("k", F.row_number().over(newest)).where("k = 1 or date_format(o_orderdate, 'yyyy-MM') < '1998-01'")
    posts = posts.select(F.col("o_custkey").alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.concat(F.lit("u"), key).alias("url"), F.when(key % 5 != 0, day).alias("released"), files.alias("attachments"))
    return forecasts.newest_supplement(posts.select("source").distinct().withColumn("latest", F.lit("1998-01")), posts)


def _tables(spark, sf):
    sources, limits, conflicts = _catalogue(spark, sf)
    return {
        "observations": views.observations(spark, sf), "forecasts": views.forecasts(spark, sf), "sources": sources, "limits": limits,
        "conflicts": conflicts.unionByName(spark.createDataFrame([("CFO", "O", "F", "증감률만", "개념")], "id string, source_a string, source_b string, level string, kind string")),
        "basis": spark.createDataFrame([("F", "수준"), ("O", "수준")], "source string, basis string"),
        "hypotheses": spark.createDataFrame([("h1",), ("h2",)], "id string"), "links": spark.createDataFrame([("h1", "supports", "1"), ("h1", "falsifies", "2"), ("h2", "supports", "9")], "hypothesis string, role string, indicator string"),
        "indicators": T(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("indicator"), F.lit(True).alias("held")),
        "capability": spark.createDataFrame([("F", ["priority"], ["orders"]), ("O", [], ["orders"])], "source string, has_axes array<string>, topics array<string>"),
    }


_PAIR = "SELECT list_aggregate(list_sort(list_distinct(list(kind))), 'string_agg', ',') AS kinds FROM (VALUES ('개념')) v(kind)"
_FIGURE = "concat_ws(':', source, series, category, period)"
_ROLES = "SELECT h || ':' || role || ':' || i AS item, CAST(count(r_regionkey) AS DOUBLE) AS value FROM (VALUES ('h1', 'supports', '1'), ('h1', 'falsifies', '2'), ('h2', 'supports', '9')) v(h, role, i) LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = i GROUP BY 1"
_ROUTES = "SELECT q || ':' || source || ':' || state AS item, CAST(NULL AS DOUBLE) AS value FROM (VALUES ('q', 'F', 'possible'), ('q', 'O', 'impossible')) v(q, source, state)"


@R.add("m14_ask", f"""SELECT 'numeric' AS kind, 'figures' AS part, {_FIGURE} AS item, value FROM {_LAST_13} UNION ALL SELECT 'compare', 'pair', 'F:O:증감률만:' || kinds, NULL FROM ({_PAIR}) UNION ALL SELECT 'compare', 'figures', {_FIGURE}, NULL FROM {_LAST_13}
    UNION ALL SELECT 'forecast', 'forecasts', CAST(ord AS VARCHAR), value FROM forecast WHERE indicator = 'Brand#13' UNION ALL SELECT 'cause', 'evidence', item, value FROM ({_ROLES})
    UNION ALL SELECT 'limits', 'meta', part || ':' || id, NULL FROM ({_META.format(x="s_suppkey IN (1, 2, 3)")}) UNION ALL SELECT 'limits', 'routes', item, value FROM ({_ROUTES}) UNION ALL SELECT 'outside', 'meta', part || ':' || id, NULL FROM ({_META.format(x="s_nationkey < 12")}) UNION ALL SELECT 'outside', 'routes', item, value FROM ({_ROUTES})""", ("observation", "forecast"))
def _(spark, sf):
    slots = ask.slots_of(spark, "긴급 주문", _DICTIONARY, "2001-08-15")
    named = {"compare": ("F", "O"), "limits": ("1", "2", "3")}
    rows = None
    for kind in ask.KINDS:
        own = ask.answered(kind, ask.answer(kind, _tables(spark, sf), slots, _DICTIONARY, named.get(kind, ()), "Brand#13"))
        rows = own if rows is None or own is None else rows.unionByName(own)
    return rows


@R.add("m02_domains", "SELECT c_custkey, domain, why IS NULL AS applies, why FROM (SELECT c_custkey, domain, CASE WHEN c_custkey % 5 = 0 THEN 'blank' WHEN domain = 'figures' AND c_mktsegment <> 'BUILDING' THEN 'no topic' END AS why FROM customer, (VALUES ('figures'), ('reports'), ('press'), ('forecasts')) d(domain))")
def _(spark, sf):
    q = T(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_name")).alias("text"), F.when(F.col("c_mktsegment") == "BUILDING", "b").alias("topic"))
    return ask.domains_that_apply(q, "text", "topic").select("c_custkey", "domain", "applies", "why")


@R.add("c06_counter_hypotheses", "SELECT * FROM (SELECT p_partkey, list_filter([CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'evidence' END, CASE WHEN p_size % 5 = 0 THEN 'counter' END], lambda x: x IS NOT NULL) AS failed FROM part) WHERE len(failed) > 0")
def _(spark, sf):
    k = F.col("p_size")
    rows = T(spark, sf, "part").select("p_partkey", F.when(k % 3 == 0, "confirmed").otherwise("open").alias("status"), F.when(k % 2 == 1, F.array(F.lit("e"))).alias("evidence"), F.when(k % 5 != 0, F.array(F.lit("h"))).alias("counter"))
    return quality.judge(rows, quality.hypothesis_rules()).where("size(failed) > 0").select("p_partkey", "failed")


@R.add("c07_lags", "SELECT rule, count(*) AS rows FROM (SELECT 'monthly' AS rule FROM part WHERE p_size % 3 = 0 AND p_size % 2 = 0 UNION ALL SELECT 'lag' FROM part WHERE p_size % 3 <> 0 AND p_size % 7 = 0) GROUP BY 1")
def _(spark, sf):
    k = F.col("p_size")
    rows = T(spark, sf, "part").select(F.when(k % 3 == 0, "precedence").alias("timing"), F.when(k % 2 == 0, "year").otherwise("month").alias("grain"), F.when(k % 7 == 0, "3").alias("lag"))
    return quality.report(quality.judge(rows, quality.link_rules()), quality.link_rules())


@R.add("c08_cutoff", "SELECT doc_id, CASE WHEN trim(title, ' ') <> '' THEN 'skipped' ELSE 'error' END AS fate FROM report WHERE published < '2022-01-01' OR trim(title, ' ') = ''", ("report",))
def _(spark, sf):
    rules = {"cutoff": F.col("published") >= "2022-01-01", "title": F.trim("title") != ""}
    skipped, failed = quality.skipped_or_failed(quality.judge(views.reports(spark, sf), rules), "cutoff")
    return skipped.select("doc_id", F.lit("skipped").alias("fate")).unionByName(failed.select("doc_id", F.lit("error").alias("fate")))


@R.add("a21f_html_lines", "SELECT o_orderkey, ['Part ' || o_orderpriority, 'a & b', strftime(o_orderdate, '%Y.%m.%d')] AS lines, strftime(o_orderdate, '%Y.%m.%d') AS date FROM orders")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    html = F.concat(F.lit("<!-- 1999.01.01 --><p>Part <b>"), "o_orderpriority", F.lit("</b></p><br/> a &amp; b <BR><div><span>"), day, F.lit("</span></div>"))
    return T(spark, sf, "orders").select("o_orderkey", text.html_lines(html).alias("lines"), text.find_date(F.regexp_replace(html, "<!--.*?-->", "")).alias("date"))


@R.add("k15_cleaned_titles", "SELECT p_partkey, 'The \"' || p_name || '\" & more' AS title FROM part")
def _(spark, sf):
    return T(spark, sf, "part").select("p_partkey", text.clean(F.concat(F.lit(" The <b>&quot;"), "p_name", F.lit("</b>&quot; &amp; more "))).alias("title"))


@R.add("e17_without_noise", "SELECT p_partkey, w FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '3개월째' WHEN 1 THEN '그래픽' WHEN 2 THEN '안정적' ELSE p_name END AS w, p_size FROM part) WHERE p_size % 4 = 3 AND w <> ''")
def _(spark, sf):
    k = F.col("p_size") % 4
    word = F.when(k == 0, "3개월째").when(k == 1, "그래픽").when(k == 2, "안정적").otherwise(F.col("p_name"))
    return T(spark, sf, "part").select("p_partkey", word.alias("w")).where(~press.is_noise(F.col("w")))


@R.add("n05_node_size", "SELECT event_type AS w, round(least(4 + 1.7 * sqrt(count(*)), 15), 6) AS radius FROM events GROUP BY 1")
def _(spark, sf):
    n = T(spark, sf, "events").groupBy(F.col("event_type").alias("w")).agg(F.count("*").alias("n"))
    return n.select("w", press.node_radius(F.col("n")).alias("radius"))
