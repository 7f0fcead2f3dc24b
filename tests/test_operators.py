"""Operators on small scenarios: ties, gaps, nulls, empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from haneul.functions import dates, numbers, text
from haneul.operators import documents, forecasts, planner, press, quality, search, series, versioning, visits

HIT = "id long, ts timestamp, day string, domain string, path string, visitor string, session string, ref string, ref_kind string"


def hits(spark, rows):
    """rows of (visitor, session, day, domain)."""
    return spark.createDataFrame([(i, None, day, domain, "/", v, s, None, "direct") for i, (v, s, day, domain) in enumerate(rows)], HIT)


WINDOW, BEFORE = visits.window_of("2026-09-30", 30)


def test_a_visitor_can_be_new_and_returning(spark):
    h = hits(spark, [("a", "a1", "2026-08-01", "x"), ("a", "a2", "2026-09-05", "x"), ("b", "b1", "2026-09-10", "x"), ("b", "b2", "2026-09-11", "y"), ("c", "c1", "2026-09-12", "y"), ("d", "d1", "2026-07-01", "x")])
    assert tuple(visits.new_and_returning(h, WINDOW).collect()[0]) == (2, 2)
    assert tuple(visits.summary(visits.within(h, WINDOW)).collect()[0]) == (3, 4, 4)
    assert {r.domain: r.returning for r in visits.returning_by_domain(h, WINDOW).collect()} == {"x": 1, "y": 1}
    assert tuple(visits.new_and_returning(h, (visits.ALL_TIME, "2026-09-30")).collect()[0]) == (4, 2)


def test_windows_and_owners(spark):
    assert visits.window_of("2026-09-30", 7) == (("2026-09-24", "2026-09-30"), ("2026-09-17", "2026-09-23"))
    assert visits.window_of("2026-09-30", 0) == (("0000-01-01", "2026-09-30"), None) and visits.window_of("2026-09-30", 12) == visits.window_of("2026-09-30", 30)
    h = hits(spark, [("a", "s", "2026-09-01", "x"), ("b", "t", "2026-09-02", "x")])
    owners = spark.createDataFrame([("a",), (None,)], "visitor string")  # a null owner removes nothing
    assert [r.visitor for r in visits.without_owners(h, owners).collect()] == ["b"]
    now = visits.compare_windows(h, WINDOW, None).collect()[0]
    assert now.views == 2 and now.prev_views is None
    assert visits.fill_days(h.where("false").groupBy("day").agg(F.count("*").alias("views")), WINDOW, ["views"]).count() == 0
    assert visits.daily(h.where("false")).count() == 0


def test_sessions_end_at_a_gap(spark):
    rows = [(1, "v", "2024-01-01 00:00:00"), (2, "v", "2024-01-01 12:00:00"), (3, "v", "2024-01-02 00:00:01"), (4, "w", "2024-01-01 00:00:00")]
    e = spark.createDataFrame(rows, "id long, visitor string, t string").withColumn("ts", F.to_timestamp("t"))
    assert {r.id: r.session for r in visits.sessionize(e, "visitor", "ts", "id").collect()} == {1: "v-1", 2: "v-1", 3: "v-2", 4: "w-1"}


SERIES = "source string, series string, breakdown string, category string, period string, value double"


def months(spark, spec):
    return spark.createDataFrame([(s, "headcount", "total", "", p, float(v)) for s, p, v in spec], SERIES)


def test_series_with_gaps(spark):
    df = months(spark, [("a", "2023-01", 1), ("a", "2023-03", 2), ("a", "2023-04", 3), ("a", "2024-03", 5), ("a", "2024-04", 9), ("b", "2024-04", 1)])
    assert {(r.source, r.period) for r in series.contiguous_tail(df, ["source"]).collect()} == {("a", "2024-03"), ("a", "2024-04"), ("b", "2024-04")}
    yoy = {(r.source, r.period): r.yoy for r in series.year_over_year(df, ["source"]).collect()}
    assert yoy["a", "2024-03"] == 3.0 and yoy["a", "2024-04"] == 6.0 and yoy["a", "2023-01"] is None and yoy["b", "2024-04"] is None
    filled = series.fill_months(df, ["source"]).where("source = 'a'").collect()
    assert len(filled) == 16 and sum(r.value is None for r in filled) == 11
    assert [r.period for r in series.thirteen_months(df, ["source"]).where("source = 'a'").orderBy("period").collect()] == ["2023-04", "2024-03", "2024-04"]
    shape = series.derive(df, ["source"]).orderBy("source").collect()
    assert [r["shape"] for r in shape] == ["time-series", "mixed"] and shape[0]["diff"] == 8.0 and shape[1]["sum"] is None
    assert series.contiguous_tail(df.where("false"), ["source"]).count() == 0


def test_missing_is_a_state(spark):
    categories = spark.createDataFrame([("age", "young", {"a": True, "b": True}), ("age", "old", {"a": True})], "breakdown string, category string, provided map<string,boolean>")
    obs = spark.createDataFrame([("a", "age", "young", "2024-01", 5.0, 1.0), ("b", "age", "young", "2024-01", 5.0, None)], "source string, breakdown string, category string, period string, value double, yoy double")
    got = {(r.category, r.source): r.state for r in series.matrix(categories, obs, ["a", "b"], "2024-01").collect()}
    assert got == {("young", "a"): "value", ("young", "b"): "noDelta", ("old", "a"): "unpublished", ("old", "b"): "notProvided"}


def test_year_is_carried_until_a_blank_row(spark):
    rows = [("t", 1, 2023, 11), ("t", 2, None, 12), ("t", 3, 2024, 1), ("t", 4, None, None), ("t", 5, None, 2)]
    got = [r.period for r in series.carried_year(spark.createDataFrame(rows, "t string, k int, year int, month int"), ["t"], "k").orderBy("k").collect()]
    assert got == ["2023-11", "2023-12", "2024-01", None, None]


FORECAST = "ord long, org string, published string, year int, half string, indicator string, value double"


def test_vintages(spark):
    f = spark.createDataFrame([(1, "x", "2024-06-01", 2024, "annual", "gdp", 2.0), (2, "x", "2024-08-01", 2024, "annual", "gdp", 2.3), (3, "y", "2024-08-01", 2024, "annual", "gdp", 2.3), (4, "y", "2024-08-01", 2024, "annual", "gdp", 1.0)], FORECAST)
    chain = {r.ord: r.revision for r in forecasts.revision_chain(f, ["org", "indicator", "year", "half"]).collect()}
    assert chain[1] is None and chain[2] == 0.3
    assert {r.org: r.ord for r in forecasts.latest_per(f, ["org"]).collect()} == {"x": 2, "y": 3}  # the first of equal dates
    s = forecasts.summarize(f, ["indicator"]).collect()[0]
    assert (s.n, s["mean"], s.max_org, s.min_org) == (4, 1.9, "x", "y")


def test_as_of_by_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice("ab"), f"2024-0{rng.randint(1, 4)}-01", 2024, "h1", "g", float(i)) for i in range(n)]
    left, right = make(40), make(30)
    for strict in (False, True):
        got = {r.ord: r.as_of_value for r in forecasts.as_of(spark.createDataFrame(left, FORECAST), spark.createDataFrame(right, FORECAST), ["org"], strict).collect()}
        for i, org, at, *_ in left:
            fit = [(p, -o, v) for o, g, p, _, _, _, v in right if g == org and (p < at or p == at and not strict)]
            assert got[i] == (max(fit)[2] if fit else None)


def test_calendar(spark):
    f = spark.createDataFrame([(i, "x", d, 2024, "annual", "g", 1.0) for i, d in enumerate(["2023-02-10", "2024-02-20", "2023-08-05", "2024-01-28"])], FORECAST)
    w = {str(r.start): str(r.end) for r in forecasts.expected_windows(f, "2024-03-01").collect()}
    assert w == {"2025-02-07": "2025-02-23", "2024-08-02": "2024-08-08", "2025-01-25": "2025-01-31"}
    merged = forecasts.merge_windows(forecasts.expected_windows(f, "2024-03-01"), 10).collect()
    assert sorted((str(r.start), str(r.end)) for r in merged) == [("2024-08-02", "2024-08-08"), ("2025-01-25", "2025-02-23")]
    late = forecasts.overdue_by_gap(f, "2025-03-01").collect()
    assert [(r.org, r.longest_gap) for r in late] == [("x", 176)] and forecasts.overdue_by_gap(f, "2024-05-01").count() == 0


def test_upsert_fates(spark):
    schema = "id string, value double, released string, note string"
    old = spark.createDataFrame([("a", 1.0, "2024-02", "old"), ("b", 1.0, "2024-02", "old"), ("c", 1.0, "2024-02", "old"), ("k", None, "2024-02", "old")], schema)
    new = spark.createDataFrame([("a", 2.0, "2024-01", "new"), ("b", 1.0, "2024-03", "new"), ("c", 3.0, "2024-03", "new"), ("d", 4.0, "2024-03", "new"), ("k", None, "2024-03", "new")], schema)
    got = {r.id: (r.action, r.value, r.note) for r in versioning.upsert(old, new, "id", "released", ["value"]).collect()}
    assert got == {"a": ("rejected", 1.0, "old"), "b": ("unchanged", 1.0, "old"), "c": ("updated", 3.0, "new"), "d": ("added", 4.0, "new"), "k": ("unchanged", None, "old")}
    batch = spark.createDataFrame([("a", 1.0, "2024-02", "x", 0), ("a", 2.0, "2024-03", "y", 1), ("a", 3.0, "2024-01", "z", 2)], schema + ", o int")
    assert versioning.last_in_batch(batch, "id", "released", "o").collect()[0].value == 2.0


def test_vintage_ids(spark):
    old = spark.createDataFrame([("x-06", 2.0), ("y-06", 1.0), ("y-06-15", 3.0), ("z-06", 1.0), ("z-06-15", 2.0)], "id string, value double")
    new = spark.createDataFrame([("x-06", "x-06-15", 2.0), ("x-06", "x-06-20", 2.5), ("y-06", "y-06-15", 4.0), ("z-06", "z-06-15", 2.0), ("w-06", "w-06-01", 1.0)], "id string, day_id string, value double")
    got = sorted((r.action, r.stored_id) for r in versioning.merge_vintages(old, new).collect())
    assert got == [("added", "w-06"), ("conflict", "y-06"), ("re-identified", "x-06-20"), ("skipped", "x-06"), ("skipped", "z-06")]


def test_digest_ignores_order_alone(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    same, other = a.orderBy(F.desc("k")), spark.createDataFrame([(1, "x"), (2, "")], "k int, v string")
    of = lambda d: versioning.digest(d, ["k", "v"]).collect()[0].digest
    assert of(a) == of(same) != of(other)


def test_checks(spark):
    rows = spark.createDataFrame([("a", "2024-13", "total", "", 1.0), ("a", "2024-01", "total", "x", 1.0), ("a", "2024-01", "age", "", None), ("a", "2024-01", "age", "x", 1.0)], "source string, period string, breakdown string, category string, value double")
    failed = [tuple(r.failed) for r in quality.judge(rows, quality.observation_rules()).collect()]
    assert failed == [("period",), ("category",), ("category", "value"), ()]
    with pytest.raises(ValueError, match="2024-13"):
        quality.require(rows.where("period = '2024-13'"), "bad period")
    known = spark.createDataFrame([("b", "2024-02-01"), ("c", "2023-01-01"), ("d", "2024-02-01")], "name string, deadline string")
    got = {r.name: r.verdict for r in quality.gate(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), known, "2024-01-01").collect()}
    assert got == {"a": "error", "b": "known", "c": "expired", "d": "recovered"}


def test_numbers_and_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    assert [one(numbers.round_half_up(F.lit(v))) for v in (-2.5, 2.5)] == [-2, 3] and one(numbers.round_decimal(F.lit(2.675), 2)) == 2.68
    assert one(numbers.change_percent(F.lit(3), F.lit(0))) is None and one(numbers.change_percent(F.lit(3), F.lit(None).cast("int"))) is None
    assert one(numbers.parse_number(F.lit("1,234.5"))) == 1234.5 and one(numbers.parse_number(F.lit("12명"))) is None
    assert one(numbers.mantissa(F.lit(2340.0))) == one(numbers.mantissa(F.lit(2.34)))
    assert one(dates.shift_month(F.lit("2024-02"), -14)) == "2022-12"
    assert [tuple(one(dates.publication_date(F.lit(t)))) and str(one(dates.publication_date(F.lit(t)))["date"]) for t in ("2024-02", "2024")] == ["2024-02-29", "2024-12-31"]
    for asked, want in (("2024년 3월 취업자", ("2024-03", "2024-03")), ("최근 3개월", ("2024-01", "2024-03")), ("작년 12월", ("2023-12", "2023-12")), ("11월 실적", ("2023-11", "2023-11")), ("지난달", ("2024-02", "2024-02")), ("고용률", None)):
        got = one(dates.parse_period(F.lit(asked), "2024-03-10"))
        assert (tuple(got) if got else None) == want


def test_text(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).collect()[0].x
    assert one(text.plain, "<style>p{a:b}</style>A&nbsp;<b>b</b> {x:1;} <!-- c -->&lt;d&gt;") == "A b <d>"
    assert one(text.terms, "청년의 고용률은 2024 a 고용률") == ["청년", "고용률", "2024"]
    long = "One two. " * 500 + "x" * 4100
    pieces = one(text.chunks, long)
    assert all(0 < len(p) <= 2000 for p in pieces) and re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", long)
    assert one(text.page_path, "#/org/k=3/2024/a/b") == "/org/k=:id/:id/a"
    match = text.dictionary_matcher({"청년": "age", "청년층": "age", "층고": "other", "제조업": "industry"})
    assert [(m.key, m.axis) for m in one(match, "청년층 고용, 제조업 · 청년")] == [("청년층", "age"), ("제조업", "industry"), ("청년", "age")]
    assert one(match, None) == []
    assert one(lambda c: search.snippet(c, "고용률"), "가" * 50 + " 고용 률 " + "나" * 90).startswith("…") and one(lambda c: search.snippet(c, "없음"), "글") is None


def test_search(spark):
    rows = [("r:1:0", "r", "고용 동향", "청년 고용", "2024-01-01"), ("r:1:1", "r", "고용 동향 2", "고용", "2024-01-02"), ("r:2:0", "r", "고용 동향", "x", "2023-01-01"), ("p:1", "p", "물가", "고용 청년", ""), ("p:2", "p", None, None, None)]
    c = spark.createDataFrame(rows, "doc_id string, domain string, title string, body string, date string")
    got = [(r.domain, r.place, r.doc_id, r.score) for r in search.search(c, ["고용", "청년"], 2).collect()]
    assert sorted(got) == [("p", 1, "p:1", 2), ("r", 1, "r:1:0", 3), ("r", 2, "r:1:1", 2)]
    assert {r.doc_id for r in search.search(c, ["고용"], 5, since="2024-01").collect()} == {"r:1:0", "r:1:1", "p:1"}
    scored = spark.createDataFrame([(d, t, x, int(s), "") for d, t, x, s in [("r:1:0", "A", "r", 9), ("r:1:1", "B", "r", 8), ("r:2:0", "A", "r", 7), ("r:3:0", "C", "r", 1)]], "doc_id string, title string, domain string, score int, date string")
    assert [(r.place, r.doc_id) for r in search.distinct_documents(scored).orderBy("place").collect()] == [(1, "r:1:0"), (2, "r:3:0")]
    assert search.distinct_documents(scored.where("false")).count() == 0
    rng = random.Random(6)
    rows = [(d, f"r:{rng.randrange(9)}:{k}", f"t{rng.randrange(7)}", f"2024-{rng.randrange(1, 4):02d}", rng.randrange(4)) for d in ("a", "b", "c") for k in range(rng.choice([3, 40, 200]))]
    want = []
    for d in ("a", "b", "c"):
        prefixes, titles = set(), set()
        for _, doc, title, date, score in sorted((r for r in rows if r[0] == d), key=lambda r: (r[4], r[3], r[1]), reverse=True):
            if len(prefixes) < 5 and doc.rsplit(":", 1)[0] not in prefixes and title not in titles:
                prefixes.add(doc.rsplit(":", 1)[0])
                titles.add(title)
                want.append((d, len(prefixes), doc))
    many = spark.createDataFrame(rows, "domain string, doc_id string, title string, date string, score int")
    assert sorted((r.domain, r.place, r.doc_id) for r in search.distinct_documents(many).collect()) == sorted(want)
    assert search.expand(["계속고용"], [["고용", "취업"], ["정년", "계속고용"]]) == ["정년", "고용", "취업"]


def test_documents(spark):
    d = spark.createDataFrame([(1, "o", "b", "t", "x", "2024-01-02"), (2, "o", "b", "t", "y", "2024-01-01"), (3, "o", "c", "t", None, "2024-01-01"), (4, "o", "c", "t", None, "2024-01-01")], "doc_id long, org string, board string, title string, body string, published string")
    assert [r.doc_id for r in documents.one_per_title(d, F.col("board") == "b").orderBy("doc_id").collect()] == [2, 3, 4]
    assert sorted((r.board, r.n) for r in documents.collapse(d, F.col("board") == "c", 1).collect()) == [("b", 1), ("b", 1), ("c", 2)]
    assert [r.doc_id for r in documents.weighted_search(d.withColumn("authors", F.array(F.lit("kim"), F.lit(None))), "k im").orderBy("doc_id").collect()] == [1, 2, 3, 4]


def test_press(spark):
    schema = "doc_id long, title string, press string, pub string, cites boolean, judged boolean, stance string, hits array<struct<axis:string,name:string>>, kw array<string>, tone array<string>"
    rows = [(i, "t", "p", f"2024-03-{11 + i:02d}", True, True, s, h, k, ["up"]) for i, (s, h, k) in enumerate([("긍정", [("age", "young")], ["boom", "chip"]), ("긍정", [("industry", "cars")], ["boom", "chip"]), ("부정", [], ["boom", "증가한"]), (None, [], ["chip"]), ("중립", [("age", "young")], [])])]
    n = spark.createDataFrame(rows, schema)
    assert [(r.w, r.n) for r in press.signals(n, "kw").collect()] == [("boom", 3), ("chip", 3)]
    assert press.stance(n).collect()[0].label == "긍정 우세" and press.stance(n.where("false")).collect()[0].label == "판정 없음"
    assert [(r.key, r.n, r.words) for r in press.issues(n).collect()] == [("all", 2, "boom,chip"), ("young", 2, "boom,chip"), ("cars", 1, "boom,chip")]
    nodes = press.graph_nodes(n, "kw")
    assert [(r.a, r.b, r.n) for r in press.graph_edges(n, "kw", nodes).collect()] == [("boom", "chip", 2)]
    frame = {r.w: r for r in press.frames(n.where("pub <= '2024-03-12'"), n.where("pub > '2024-03-12'"), "kw", "2024-03-11", covered=3).collect()}
    assert set(frame) == {"boom", "chip"} and frame["boom"].state == "유지" and list(frame["chip"].series) == [1, 1, 0, 1]
    assert [(r.topic, r.n) for r in press.rivals(n, F.col("kw")).collect()] == [("boom", 3), ("그 밖", 2)]


def test_collection_kind(spark):
    days = spark.createDataFrame([(d,) for d in ("2024-01-05", "2024-01-11", "2024-01-12", "2024-02-02", "2024-02-03", "2024-04-01")], "day string")
    releases = spark.createDataFrame([("2024-01-11",)], "release string")
    got = {r.day: r.kind for r in forecasts.collection_kind(days, releases).collect()}
    assert got == {"2024-01-05": "none", "2024-01-11": "regular", "2024-01-12": "regular", "2024-02-02": "follow", "2024-02-03": "none", "2024-04-01": "none"}


def test_figures(spark):
    t = "2026년 7월 30~39세 취업자는 29,151천명으로 -2.3% 줄고 1.5년, 2025S1, 3분기 1,234대"
    assert list(spark.createDataFrame([(t,)], "t string").select(planner.figures(F.col("t")).alias("f")).collect()[0].f) == [29151.0, -2.3, 1.5, 1234.0]


def test_a_counted_year_is_a_figure(spark):
    texts = {"2001건, 1999명과 2024천명": [2001.0, 1999.0, 2024.0], "2001년 12건, 2024-03, 2024는 그대로": [12.0]}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", planner.figures(F.col("t")).alias("f")).collect()
    assert {r.t: list(r.f) for r in got} == texts
