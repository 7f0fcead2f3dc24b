"""Printed tables, sections and run states."""

from pyspark.sql import functions as F

from haneul.functions import printed as p
from haneul.operators import printed, status


def each(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_scalars(spark):
    assert each(spark, p.period_of_title, ["고용동향('24년 3월)", "2023년 12월 결과", "24년 13월", None]) == ["2024-03", "2023-12", None, None]
    assert each(spark, p.unbolded, ["성성성장장장률률률 222...111", "1,000 명", "aaa bb"]) == ["성장률 2.1", "1,000 명", "aaa bb"]
    assert each(spark, p.row_label, ["취업자 증감(만명) 23 △1.5", "GDP 1) 2.1"]) == ["취업자 증감", "GDP"]
    assert each(spark, p.row_figures, ["취업자 증감(만명) 1,023 △1.5 [2.0]"]) == [[1023.0, -1.5]]
    assert each(spark, p.headline_change, ["27만 7천명 증가", "3천명 감소", "12만명 늘어", "그대로"]) == [277.0, -3.0, 120.0, None]
    assert [str(x) if x else None for x in each(spark, lambda c: p.schedule_date(c, 2026), ["2.9 (월)", "2월 30일", "미정"])] == ["2026-02-09", None, None]
    assert each(spark, lambda c: p.tags_of(c, {"trade": ["수출"], "oil": ["유가"]}, ["유가증권"]), ["수출과 유가증권", "유가 상승"]) == [["trade"], ["oil"]]
    assert each(spark, lambda c: p.unknown_acronym(c, ["GDP"]), ["GDP QXZ up", "GDP"]) == ["QXZ", None]
    assert each(spark, p.topic_particle, ["청년", "제조업체", "A"]) == ["은", "는", "는"]
    assert each(spark, lambda c: p.trend_name(c, {"29세이하": "청년"}), ["반도체(전자·통신)", "29세이하"]) == ["반도체", "청년"]
    assert each(spark, p.nfkc, ["①㎏", None]) == ["1kg", None]
    source = F.lit("수출이 크게\n 늘면서 성장률이 올랐다.\n\n그러나 소비는")
    assert each(spark, lambda c: p.quoted(c, source), ["수출이 크게 늘면서", "출이 크게", "올랐다. 그러나", "", None]) == [True, False, False, False, False]


def test_tables(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["표 1", "구분 2024 2025", "성장률(%) 2.1 1.9", "각주 3", "물가 △0.5 2.0"])], "doc string, k int, line string")
    got = sorted((r.label, r.column, r.value) for r in printed.grid(lines, ["doc"]).collect())
    assert got == [("물가", "2024", -0.5), ("물가", "2025", 2.0), ("성장률", "2024", 2.1), ("성장률", "2025", 1.9)]
    words = spark.createDataFrame([("d", 10.0, 0.0, "GDP"), ("d", 12.0, 100.0, "2.1"), ("d", 11.0, 205.0, "△1.9"), ("d", 30.0, 102.0, "7"), ("d", 30.0, 160.0, "9")], "doc string, top double, left double, text string")
    heads = spark.createDataFrame([("d", "2024", 100.0), ("d", "2025", 200.0)], "doc string, column string, at double")
    cells = {(r.row, r.column): r.value for r in printed.nearest_columns(printed.placed_words(words, ["doc"]), heads, ["doc"]).collect()}
    assert cells == {(1, "2024"): 2.1, (1, "2025"): -1.9, (2, "2024"): 7.0}
    s = spark.createDataFrame([("d", i, t) for i, t in enumerate(["x", "고용", "취업자 1", "물가", "2", "기타", "3"])], "doc string, k int, line string")
    assert [r.section for r in printed.sections(s, ["doc"], ["고용", "물가"], ["기타"]).orderBy("k").collect()] == [None, "고용", "고용", "물가", "물가", None, None]
    b = spark.createDataFrame([("d", i, t) for i, t in enumerate(["□ 앞", "요약", "○ 하나", "글", "- 둘", "본문", "- 셋"])], "doc string, k int, line string")
    assert [r.line for r in printed.summary_lines(b, ["doc"], F.col("line") == "요약", F.col("line") == "본문").orderBy("place").collect()] == ["하나", "둘"]


def test_pages(spark):
    texts = ["Cover", "Report\nSummary\nThe econo-", "Report\nmy grows", "Report\nChapter 1", "Korea\nnote", "more on Korea"]
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc string, page int, text string")
    assert printed.abstracts(pages, ["doc"], F.col("text").contains("Summary"), F.col("text").contains("Chapter")).collect()[0].abstract == "Summary\nThe economy grows"
    assert [r.page for r in printed.country_pages(pages, ["doc"], "Korea").orderBy("page").collect()] == [5, 6]


def test_status(spark):
    m = spark.createDataFrame([("a", '{"run_at":"2024-01-02T00:00:00Z","errors":[],"rows":3}'), ("b", '{"at":"2024-01-01T00:00:00Z","errors":["x"]}'), ("c", "[]"), ("d", '{"rows":1}')], "domain string, body string")
    got = {r.domain: (r.hours, r.malformed, list(r.warnings)) for r in status.indicators(m, F.lit("2024-01-02 05:00:00").cast("timestamp")).collect()}
    assert got == {"a": (5, False, []), "b": (29, False, ["stale", "errors"]), "c": (None, True, ["malformed"]), "d": (None, True, ["malformed"])}
    menu = spark.createDataFrame([(1, "http://a/x/?p=1"), (2, "http://a/y"), (3, "http://a/Y/")], "o int, url string")
    assert [r.url for r in status.unregistered(menu, spark.createDataFrame([("http://A/x",)], "url string"), "url", "o").collect()] == ["http://a/y"]
    att = spark.createDataFrame([("p", "table", "a.pdf"), ("p", "table", "b.xlsx"), ("p", "text", "c.zip")], "post string, kind string, url string")
    assert [tuple(r) for r in status.preferred(att, ["post"], ["xlsx", "pdf"]).collect()] == [("p", "table", "b.xlsx")]
    posts = spark.createDataFrame([("2024-01", None, True), ("2024-02", "s", True), ("2024-03", None, False), ("2023-01", None, True)], "month string, summary string, has_document boolean")
    assert [r.month for r in status.needs_summary(posts, 3).collect()] == ["2024-01"]
    assert spark.range(1).select(status.due_hours(F.lit(1), 8, 6).alias("h")).collect()[0].h == [8, 9, 15, 21]
