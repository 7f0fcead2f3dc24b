"""Visits as bitmaps, and columns that repeat what driver-side functions do."""

import random

from pyspark.sql import functions as F

from haneul.operators import search, visit_rollup, visits


def test_rollup_counts_exactly_and_grows(spark):
    rng = random.Random(1)
    rows = [(f"2024-01-{rng.randrange(1, 10):02d}", rng.choice(["a", "b", None]), rng.choice([None, *[f"v{i}" for i in range(300)]])) for _ in range(4_000)]
    hits = spark.createDataFrame(rows, "day string, domain string, visitor string")
    early = visit_rollup.dictionary(hits.where("day < '2024-01-04'"), "visitor")
    numbers = visit_rollup.dictionary(hits, "visitor", early)
    known = {r.visitor: r.number for r in numbers.collect()}
    assert sorted(known.values()) == list(range(len(known))) == list(range(len({v for *_, v in rows if v})))
    assert {r.visitor: r.number for r in early.collect()}.items() <= known.items()  # numbers never change
    rolled = visit_rollup.rollup(hits, numbers)
    count = lambda keep: (len({v for d, x, v in rows if keep(d, x) and v}), sum(keep(d, x) for d, x, v in rows))
    for first, last in (("2024-01-01", "2024-01-09"), ("2024-01-03", "2024-01-05"), ("2024-01-07", "2024-01-07")):
        own = rolled.where(F.col("day").between(first, last))
        got = {r.domain: (r.visitors, r.views) for r in visit_rollup.totals(own, "domain").collect()}
        assert got == {x: count(lambda d, y, x=x: first <= d <= last and y == x) for x in ("a", "b", None)}
        assert tuple(visit_rollup.totals(own).first()) == count(lambda d, y: first <= d <= last)
    three = {(r.day, r.domain): r.visitors for r in visit_rollup.moving(rolled, 3).collect()}
    assert three["2024-01-05", "a"] == count(lambda d, y: "2024-01-03" <= d <= "2024-01-05" and y == "a")[0]
    assert visit_rollup.rollup(hits.limit(0), numbers).count() == 0


def test_bitmaps_span_buckets(spark):
    hits = spark.range(70_000).select(F.lit("2024-01-01").alias("day"), F.lit("a").alias("domain"), F.col("id").cast("string").alias("visitor"))
    rolled = visit_rollup.rollup(hits, visit_rollup.dictionary(hits, "visitor"))
    assert rolled.count() > 2 and tuple(visit_rollup.totals(rolled).first()) == (70_000, 70_000)


def test_columns_equal_driver_functions(spark):
    groups = [["고용", "취업", "일자리"], ["정년", "계속 고용", "고령자"], ["물가", "인플레이션"], ["a", "bc"]]
    rng = random.Random(3)
    words = sum(groups, []) + ["고용률", "정년 연장", "b", "", " ", "물"]
    asked = [[rng.choice(words) for _ in range(rng.randrange(4))] for _ in range(80)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a array<string>")
    assert {r.i: r.w for r in df.select("i", search.expanded(F.col("a"), groups).alias("w")).collect()} == {i: search.expand(a, groups) for i, a in enumerate(asked)}
    lengths = spark.createDataFrame([("2024-03-01", n) for n in (0, 1, 7, 12, 30, 90)], "t string, n int")
    for r in lengths.select("n", visits.windows_of(F.col("t"), F.col("n")).alias("w")).collect():
        (a, b), before = visits.window_of("2024-03-01", r.n)
        assert tuple(r.w) == (a, b, *(before or (None, None)))
