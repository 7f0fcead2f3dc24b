"""Merges that touch their buckets alone, boards, and texts of the catalogue."""

import glob

import pytest

from haneul.operators import search
from haneul.sinks.buckets import Buckets
from haneul.sources import files

SCHEMA = "id string, value double, released string"


def test_a_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), SCHEMA, "id", 16)
    assert t.read().count() == 0 and t.newest() is None
    rows = [(f"k{i}", float(i), "1") for i in range(200)] + [(None, 0.0, "1")]
    assert t.merge(spark.createDataFrame(rows, SCHEMA), "released", ["value"], batch=0) == {"added": 201}
    before = t.newest()["folders"]
    batch = spark.createDataFrame([("k7", 70.0, "2"), ("k7", 71.0, "2"), ("k7", 99.0, "1"), ("new", 1.0, "1")], SCHEMA)
    counts = t.merge(batch, "released", ["value"], batch=1)
    assert counts["updated"] == 1 and counts["added"] == 1 and counts["kept"] < 60
    after = t.newest()
    assert {b for b, f in after["folders"].items() if before.get(b) != f} == {str(b) for b in after["touched"]} and len(after["touched"]) <= 2
    got = {r.id: r.value for r in t.read().collect()}
    assert got == {k: v for k, v, _ in rows} | {"k7": 71.0, "new": 1.0}
    assert t.merge(batch, "released", ["value"], batch=1) == {} and t.newest() == after  # ran already
    files_ = len(glob.glob(str(tmp_path / "t/*/_bucket=*/*.parquet")))
    assert t.merge(spark.createDataFrame([("k7", 1.0, "0")], SCHEMA), "released", ["value"])["rejected"] == 1
    assert len(glob.glob(str(tmp_path / "t/*/_bucket=*/*.parquet"))) == files_ + 1 and {r.id: r.value for r in t.read().collect()} == got


def test_of_two_merges_the_second_fails(spark, tmp_path, monkeypatch):
    one, other = (Buckets(spark, str(tmp_path / "t"), SCHEMA, "id", 4) for _ in range(2))
    one.merge(spark.createDataFrame([("a", 1.0, "1")], SCHEMA), "released", ["value"])
    before = other.newest()
    one.merge(spark.createDataFrame([("a", 2.0, "2")], SCHEMA), "released", ["value"])
    monkeypatch.setattr(other, "newest", lambda: before)
    with pytest.raises(Exception, match="(?i)exist"):
        other.merge(spark.createDataFrame([("a", 3.0, "3")], SCHEMA), "released", ["value"])
    assert [tuple(r) for r in one.read().collect()] == [("a", 2.0, "2")]


def test_unreadable_pages_are_not_empty(spark):
    pages = spark.createDataFrame([("s", 1, "x"), ("s", 2, None), ("s", 3, "x"), ("s", 4, "none"), ("s", 5, "x"), ("t", 1, "none"), ("t", 2, "x")], "source string, page int, html string")
    posts = spark.createDataFrame([("s", 1, 0, "2024-02", "a"), ("s", 3, 0, "2024-01", "b"), ("s", 3, 1, "2024-02", "c"), ("s", 5, 0, "2023-12", "d"), ("t", 2, 0, "2024-01", "e")], "source string, page int, place int, period string, title string")
    assert sorted((r.source, r.period, r.title) for r in files.read_boards(pages, posts).collect()) == [("s", "2024-01", "b"), ("s", "2024-02", "a"), ("t", "2024-01", "e")]
    with pytest.raises(ValueError, match="couldn't be read"):
        files.read_boards(pages, posts, strict=True)
    assert files.read_boards(pages.where("html is not null"), posts, strict=True).count() == 3


def test_rounds_and_catalogue_as_texts(spark):
    rounds = spark.createDataFrame([("2024-01", None, None, None, None, None), ("2024-02", "", "T", ["a", "b"], [("w", 2)], [("k", 3, ["h1", "h2", "h3", "h4"])])], "release string, label string, title string, gaps array<string>, tone array<struct<w:string,n:int>>, issues array<struct<key:string,n:int,heads:array<string>>>")
    assert [(r.doc_id, r.title, r.body) for r in search.press_rounds(rounds).collect()] == [("press:2024-02:회차:0", "T", "a b 자주 쓰인 낱말: w 2건 쟁점 k 3건 — h1 / h2 / h3")]
    names = spark.createDataFrame([("a", "Alpha")], "id string, name string")
    conflicts = spark.createDataFrame([("1", "a", "b", "개념", "long. " * 900)], "id string, source_a string, source_b string, kind string, text string")
    limits = spark.createDataFrame([("2", "a", "기간", None, "why")], "id string, source string, kind string, text string, reason string")
    got = {r.doc_id: r for r in search.catalogue_texts(names, conflicts, limits).collect()}
    assert set(got) == {"catalog:충돌:1:0", "catalog:충돌:1:1", "catalog:충돌:1:2", "catalog:한계:2:0"}
    assert got["catalog:충돌:1:0"].title == "Alpha ↔ b · 개념" and got["catalog:한계:2:0"].body == "why" and got["catalog:한계:2:0"].title == "Alpha · 기간"
    with pytest.raises(ValueError, match="too short"):
        search.search_indexed(conflicts, None, ["ab"])
