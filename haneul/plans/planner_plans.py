"""Plans over questions, catalogues and evidence: a region is a source, a nation an axis, a market segment a topic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import planner, quality
from . import views
from .registry import Registry

TODAY = "2024-03-10"
R = Registry({
    "place": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "capability": "SELECT r_name AS source, list(DISTINCT c_mktsegment) AS topics, list(DISTINCT n_name) AS has_axes FROM customer JOIN place ON c_nationkey = n_nationkey WHERE c_acctbal > 8000 GROUP BY 1",
    "question": "SELECT c_custkey AS q, c_mktsegment AS topic, [n_name, (SELECT max(n_name) FROM nation)] AS axes FROM customer JOIN place ON c_nationkey = n_nationkey",
    "conflict": "SELECT DISTINCT least(a.r_name, b.n_name) AS source_a, greatest(a.r_name, b.n_name) AS source_b, CASE (length(a.r_name) + length(b.n_name)) % 3 WHEN 0 THEN '불가' WHEN 1 THEN '증감률만' ELSE '수준' END AS level, substr(b.n_name, 1, 1) AS kind FROM place a JOIN nation b ON a.n_nationkey = b.n_nationkey UNION ALL SELECT n_name, r_name, '수준', 'z' FROM place",
    "indicator": "SELECT p_partkey AS indicator, p_size > 5 AS held, CASE p_size % 4 WHEN 0 THEN 'year' ELSE 'month' END AS grain, p_type = 'PROMO' AS rate_only FROM part",
    "link": "SELECT DISTINCT l_suppkey AS hypothesis, l_partkey AS indicator, CASE l_returnflag WHEN 'R' THEN 'falsifies' ELSE 'supports' END AS role FROM lineitem WHERE l_quantity > 49",
    "hypothesis": "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN 'month' ELSE 'year' END AS grain FROM supplier",
})
PLACE, ROUTE, EVIDENCE = ("place",), ("place", "capability", "question"), ("indicator", "link", "hypothesis")


def _places(spark, sf):
    return views.table(spark, sf, "nation").join(views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def _customers(spark, sf):
    return views.table(spark, sf, "customer").join(F.broadcast(_places(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations


def _capability(spark, sf):
    return _customers(spark, sf).where("c_acctbal > 8000").groupBy(F.col("r_name").alias("source")).agg(F.collect_set("c_mktsegment").alias("topics"), F.collect_set("n_name").alias("has_axes"))


def _questions(spark, sf):
    last = views.table(spark, sf, "nation").agg(F.max("n_name").alias("last"))
    return _customers(spark, sf).crossJoin(F.broadcast(last)).select(F.col("c_custkey").alias("q"), F.col("c_mktsegment").alias("topic"), F.array("n_name", "last").alias("axes"))  # one row


def _conflicts(spark, sf):
    p = _places(spark, sf)
    n = F.length("r_name") + F.length("n_name")
    level = F.when(n % 3 == 0, "불가").when(n % 3 == 1, "증감률만").otherwise("수준")
    first = p.select(F.least("r_name", "n_name").alias("source_a"), F.greatest("r_name", "n_name").alias("source_b"), level.alias("level"), F.substring("n_name", 1, 1).alias("kind")).distinct()
    return first.unionByName(p.select(F.col("n_name").alias("source_a"), F.col("r_name").alias("source_b"), F.lit("수준").alias("level"), F.lit("z").alias("kind")))


def _evidence(spark, sf):
    t = lambda n: views.table(spark, sf, n)
    indicators = t("part").select(F.col("p_partkey").alias("indicator"), (F.col("p_size") > 5).alias("held"), F.when(F.col("p_size") % 4 == 0, "year").otherwise("month").alias("grain"), (F.col("p_type") == "PROMO").alias("rate_only"))
    links = t("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("hypothesis"), F.col("l_partkey").alias("indicator"), F.when(F.col("l_returnflag") == "R", "falsifies").otherwise("supports").alias("role")).distinct()
    hypotheses = t("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, "month").otherwise("year").alias("grain"))
    return hypotheses, links, indicators


@R.add("m04_route", """SELECT q, source, CASE WHEN len(axes) > 0 AND len(list_intersect(axes, has_axes)) = 0 THEN 'impossible' WHEN len(list_filter(axes, lambda a: NOT list_contains(has_axes, a))) > 0 THEN 'partial' ELSE 'possible' END AS state,
    array_to_string(list_sort(list_distinct(list_filter(axes, lambda a: NOT list_contains(has_axes, a)))), ',') AS lacking FROM question JOIN capability ON list_contains(topics, topic)""", ROUTE)
def _(spark, sf):
    return planner.route(_questions(spark, sf), _capability(spark, sf))


@R.add("m16_comparable", "SELECT p.n_name AS a, r.r_name AS b, CASE coalesce(min(CASE c.level WHEN '불가' THEN 0 WHEN '증감률만' THEN 1 WHEN '수준' THEN 2 END), 0) WHEN 0 THEN '불가' WHEN 1 THEN '증감률만' ELSE '수준' END AS level, coalesce(array_to_string(list_sort(list_distinct(list(c.kind) FILTER (WHERE c.kind IS NOT NULL))), ','), '') AS kinds FROM place p CROSS JOIN region r LEFT JOIN conflict c ON (c.source_a = p.n_name AND c.source_b = r.r_name) OR (c.source_b = p.n_name AND c.source_a = r.r_name) GROUP BY 1, 2", ("place", "conflict"))
def _(spark, sf):
    regions = views.table(spark, sf, "region").select(F.col("r_name").alias("b"))
    pairs = _places(spark, sf).select(F.col("n_name").alias("a")).crossJoin(F.broadcast(regions))  # 25 by 5
    return planner.comparable(pairs, _conflicts(spark, sf))


@R.add("f13_both_ends", "SELECT * FROM conflict WHERE source_a IN (SELECT n_name FROM place WHERE r_name <> 'ASIA' UNION SELECT r_name FROM region) AND source_b IN (SELECT n_name FROM place WHERE r_name <> 'ASIA' UNION SELECT r_name FROM region)", ("place", "conflict"))
def _(spark, sf):
    ids = _places(spark, sf).where("r_name <> 'ASIA'").select(F.col("n_name").alias("id")).unionByName(views.table(spark, sf, "region").select(F.col("r_name").alias("id")))
    return planner.both_ends(_conflicts(spark, sf), ids).select("source_a", "source_b", "level", "kind")


@R.add("f21_conflict_names", "SELECT source_a || ' · ' || coalesce(r.r_name, '?') AS title, level FROM conflict LEFT JOIN place r ON source_b = r.n_name", ("place", "conflict"))
def _(spark, sf):
    names = _places(spark, sf).select(F.col("n_name").alias("source_b"), "r_name")
    return _conflicts(spark, sf).join(F.broadcast(names), "source_b", "left").select(F.concat("source_a", F.lit(" · "), F.coalesce("r_name", F.lit("?"))).alias("title"), "level")  # 25 rows


@R.add("g24_hypothesis_verdicts", """SELECT id, n_falsify, n_missing, n_falsify > 0 AND n_missing = 0 AS capable, CASE WHEN n_falsify > 0 AND n_missing = 0 THEN CASE WHEN n_weak > 0 THEN 'weak' ELSE 'strong' END END AS strength, CASE WHEN n_falsify = 0 THEN 'no falsifier' WHEN n_missing > 0 THEN 'data not held' END AS blocked_by FROM (
    SELECT h.id, count(l.indicator) AS n_falsify, count(*) FILTER (WHERE l.indicator IS NOT NULL AND NOT coalesce(i.held, false)) AS n_missing, count(*) FILTER (WHERE i.grain <> h.grain OR i.rate_only) AS n_weak FROM hypothesis h LEFT JOIN link l ON l.hypothesis = h.id AND l.role = 'falsifies' LEFT JOIN indicator i ON i.indicator = l.indicator GROUP BY 1)""", EVIDENCE)
def _(spark, sf):
    return planner.verdicts(*_evidence(spark, sf))


@R.add("m10_evidence_by_role", "SELECT h.id AS hypothesis, role, array_to_string(list_sort(list_distinct(list(CAST(l.indicator AS VARCHAR)))), ',') AS indicators, count(*) FILTER (WHERE held) AS held FROM hypothesis h JOIN link l ON l.hypothesis = h.id LEFT JOIN indicator i ON i.indicator = l.indicator GROUP BY 1, 2", EVIDENCE)
def _(spark, sf):
    return planner.evidence(*_evidence(spark, sf))


@R.add("m11_indicator_fallback", "SELECT indicator, grain FROM (SELECT *, bool_or(rate_only AND held AND indicator % 97 = 0) OVER (PARTITION BY grain) AS any_ FROM indicator) WHERE rate_only AND held AND indicator % 97 = 0 OR NOT any_", EVIDENCE)
def _(spark, sf):
    return planner.fallback(_evidence(spark, sf)[2], "grain", F.col("rate_only") & F.col("held") & (F.col("indicator") % 97 == 0)).select("indicator", "grain")


@R.add("g26_conservative_basis", "SELECT grain, CASE WHEN bool_and(held) AND NOT bool_or(rate_only) THEN '수준' ELSE '증감률만' END AS basis FROM indicator GROUP BY 1", EVIDENCE)
def _(spark, sf):
    return planner.basis(_evidence(spark, sf)[2].withColumnRenamed("held", "known"), ["grain"])


@R.add("g31_declared_capability", "SELECT r_name AS source, c_mktsegment AS axis, bool_or(b) AS capable FROM (SELECT r_name, c_mktsegment, c_custkey, c_acctbal > 9000 AS b FROM customer JOIN place ON c_nationkey = n_nationkey) GROUP BY 1, 2", PLACE)
def _declared(spark, sf):
    rows = _customers(spark, sf).select(F.col("c_mktsegment").alias("axis"), F.col("c_custkey").alias("category"), F.create_map("r_name", F.col("c_acctbal") > 9000).alias("provided"))
    return planner.declared(rows, "axis", "source", "provided")[0]


@R.add("k61_axes_fit", "SELECT c_custkey, (c_acctbal > 0) AS fits FROM customer")
def _(spark, sf):
    c = views.table(spark, sf, "customer")
    declared = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("sign"), F.when(F.col("c_acctbal") > 0, "plus").otherwise("minus"))
    asked = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("sign"), F.lit("plus"))
    return c.select("c_custkey", planner.axes_fit(asked, declared).alias("fits"))


_ANSWER = "strftime(o_orderdate, '%Y년 %-m월') || ' 30~39세 합계 ' || format('{:,.2f}', o_totalprice) || '천명, ' || CAST(o_custkey AS VARCHAR) || '건'"


def _answers(spark, sf):
    o = views.table(spark, sf, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy년 M월"), F.lit(" 30~39세 합계 "), F.format_number("o_totalprice", 2), F.lit("천명, "), F.col("o_custkey").cast("string"), F.lit("건"))
    return o.select("o_orderkey", "o_totalprice", "o_custkey", text.alias("answer"))


@R.add("k18_figures", "SELECT o_orderkey, o_totalprice AS first, CAST(o_custkey AS DOUBLE) AS second, 2 AS n FROM orders")
def _(spark, sf):
    f = planner.figures(F.col("answer"))
    return _answers(spark, sf).select("o_orderkey", f[0].alias("first"), f[1].alias("second"), F.size(f).alias("n"))


@R.add("m09_verify_answers", "SELECT o_orderkey, CASE WHEN o_custkey = o_totalprice THEN 0 ELSE 1 END AS outside, CASE WHEN o_custkey = 7 THEN 1 ELSE 0 END AS notation FROM (SELECT * FROM orders)")
def _(spark, sf):
    # 0.7 is customer 7 in another unit, and no customer's key itself
    v = planner.verify(_answers(spark, sf).withColumn("allowed", F.array("o_totalprice", F.lit(0.7))).withColumn("allowed", F.filter("allowed", lambda x: x.isNotNull())), "answer", "allowed")
    exact = F.filter("notation", lambda x: x == 7.0)
    return v.select("o_orderkey", F.size("outside").alias("outside"), F.size(exact).alias("notation"))


@R.add("m01_slots", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'BUILDING' THEN 'B' END AS topic FROM customer")
def _(spark, sf):
    c = views.table(spark, sf, "customer").withColumn("ask", F.concat(F.lit("how is "), F.lower("c_mktsegment"), F.lit(" doing")))
    return planner.slots(c, "ask", {"machine": "X", "machinery": "M", "build ing": "B"}, "topic").select("c_custkey", "topic")


_WHEN = "CASE c_custkey % 6 WHEN 0 THEN strftime(d, '%Y년 %-m월') WHEN 1 THEN '최근 6개월' WHEN 2 THEN '작년 3월' WHEN 3 THEN '지난달' WHEN 4 THEN strftime(d, '%Y년') ELSE strftime(d, '%-m월') END"


@R.add("k42_period_of_question", """SELECT q, CASE k WHEN 0 THEN strftime(d, '%Y-%m') WHEN 1 THEN '2023-10' WHEN 2 THEN '2023-03' WHEN 3 THEN '2024-02' WHEN 4 THEN strftime(d, '%Y-01') ELSE CASE WHEN month(d) > 3 THEN '2023' ELSE '2024' END || strftime(d, '-%m') END AS "from",
    CASE k WHEN 0 THEN strftime(d, '%Y-%m') WHEN 1 THEN '2024-03' WHEN 2 THEN '2023-03' WHEN 3 THEN '2024-02' WHEN 4 THEN strftime(d, '%Y-12') ELSE CASE WHEN month(d) > 3 THEN '2023' ELSE '2024' END || strftime(d, '-%m') END AS "to" FROM (SELECT o_orderkey AS q, o_orderkey % 6 AS k, o_orderdate AS d FROM orders)""")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    asked = F.when(k == 0, F.date_format(d, "yyyy년 M월")).when(k == 1, "최근 6개월").when(k == 2, "작년 3월").when(k == 3, "지난달").when(k == 4, F.date_format(d, "yyyy년")).otherwise(F.date_format(d, "M월"))
    p = dates.parse_period(asked, TODAY)
    return o.select(F.col("o_orderkey").alias("q"), p["from"].alias("from"), p["to"].alias("to"))


@R.add("c05_conditional_rules", "SELECT 'evidence' AS rule, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS rows FROM customer UNION ALL SELECT 'counter', count(*) FILTER (WHERE c_nationkey % 2 = 0) FROM customer")
def _(spark, sf):
    c = views.table(spark, sf, "customer")
    confirmed, evidence = F.col("c_acctbal") > 0, F.when(F.col("c_mktsegment") != "BUILDING", F.lit("e"))
    rules = {"evidence": ~confirmed | evidence.isNotNull(), "counter": F.size(F.when(F.col("c_nationkey") % 2 == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.lit("h")))) > 0}
    return quality.report(quality.judge(c, rules), rules)


@R.add("f03_multi_hop", "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey GROUP BY 1, 2", PLACE)
def _(spark, sf):
    o = views.table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    j = o.join(_customers(spark, sf).select("c_custkey", "c_mktsegment", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
