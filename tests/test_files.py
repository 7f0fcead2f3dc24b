"""Readers, sinks and streams on generated files."""

import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from haneul.sinks import packing, tables
from haneul.sources import files, office
from haneul.sources.registry import Collectors, DocumentSources
from haneul.sources.schemas import TABLES, columns, project
from haneul.streaming import beacons


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


def test_json_tables(spark, tmp_path):
    assert files.read_table(spark, str(tmp_path / "none.json"), "observation").columns == columns("observation")
    a = put(tmp_path / "a.json", [{"id": "x", "source": "s", "value": 1.5, "released_at": "2024-01-02", "extra": 1}, {"id": "y", "category": None}])
    rows = {r.id: r for r in files.read_unique(spark, a, "observation").collect()}
    assert rows["x"].value == 1.5 and str(rows["x"].released_at) == "2024-01-02" and rows["y"].value is None
    put(tmp_path / "d/b.json", [{"id": "x", "value": 1.0}, {"id": "z", "value": 3.0}])
    put(tmp_path / "d/c.json", [{"id": "x", "value": 2.0}])
    with pytest.raises(ValueError, match="'x'"):
        files.read_unique(spark, [str(tmp_path / "d")], "observation")
    assert {r.id: r.value for r in files.read_overrides(spark, str(tmp_path / "d"), "observation").collect()} == {"x": 2.0, "z": 3.0}
    put(tmp_path / "deep/e/f/g.json", [{"id": "q"}])
    assert files.read_table(spark, str(tmp_path / "deep"), "observation", recursive=True).count() == 1
    put(tmp_path / "s/abs-a.json", {"1": "a", "2": "b"})
    put(tmp_path / "s/abs-b.json", {"2": "c"})
    assert {r.id: r.text for r in files.read_shards(spark, str(tmp_path / "s/abs-*.json")).collect()} == {"1": "a", "2": "c"}


def test_releases_and_rounds(spark, tmp_path):
    r = put(tmp_path / "r.json", {"ei": {"2024-01": {"title": "t", "posted_at": "2024-02-10", "url": "u"}, "2024-02": {"attachments": [{"type": "pdf", "url": "v"}]}}})
    got = {x.id: x for x in files.read_releases(spark, r).collect()}
    assert set(got) == {"ei-2024-01", "ei-2024-02"} and got["ei-2024-01"].attachments == [] and got["ei-2024-02"].attachments[0].url == "v"
    for n in ("2024-03-11-regular", "2024-03-11-follow", "2024-04-08-regular", "other"):
        put(tmp_path / f"rounds/{n}.json", "{}")
    assert {x.release: x.kinds for x in files.rounds_on_disk(spark, str(tmp_path / "rounds")).collect()} == {"2024-03-11": ["follow", "regular"], "2024-04-08": ["regular"]}


def test_sdmx(spark, tmp_path):
    c = put(tmp_path / "x.csv", "REF_AREA,FREQ,MEASURE,TIME_PERIOD,OBS_VALUE\nKOR,A,GDP,2024,2.5\nKOR,A,GDP,2025,\nKOR,Q,GDP,2024,9\nJPN,A,GDP,2024,1\n")
    assert [tuple(r) for r in files.read_sdmx_csv(spark, c).collect()] == [("GDP", 2024, 2.5)]
    j = put(tmp_path / "x.json", {"data": {"structures": [{"dimensions": {"observation": [{"values": [{"value": "2024"}, {"value": "2025"}]}]}}], "dataSets": [{"series": {"0:0": {"observations": {"1": ["2.1"], "0": ["1.9", "x"]}}}}]}})
    assert sorted((r.period, r.value) for r in files.read_sdmx_json(spark, j).collect()) == [("2024", 1.9), ("2025", 2.1)]
    x = put(tmp_path / "x.xml", '<a><Obs TIME_PERIOD="2024" OBS_VALUE="1.5"/><m:Obs OBS_VALUE="" TIME_PERIOD="2025"/></a>')
    assert sorted((r.period, r.value) for r in files.read_sdmx_xml(spark, x).collect()) == [("2024", 1.5), ("2025", None)]
    wide = spark.createDataFrame([("KOR", "1.5", ".")], "iso string, S2024 string, F2024 string")
    assert sorted((r.vintage, r.value) for r in files.vintages_of_wide(wide, ["iso"]).collect()) == [("F2024", None), ("S2024", 1.5)]


def test_feeds_lists_and_crawls(spark, tmp_path):
    f = put(tmp_path / "f.xml", "<rss><item><title><![CDATA[경제전망 8월]]></title><link>http://b/1</link><pubDate>d1</pubDate></item><item><title>other</title><link>u</link></item></rss>")
    assert [tuple(r) for r in files.read_rss(spark, f, "전망").collect()] == [("경제전망 8월", "d1", "http://b/1")]
    html = "<table><tr><th>no</th></tr><tr><td><a href='/v?id=3'>고용 동향</a></td><td>2024.03.11</td></tr><TR><td>다른 글</td></TR></table>"
    pages = spark.createDataFrame([(1, html)], "n int, html string")
    assert [(r.title, r.date, r.link) for r in files.list_rows(pages, "html", "고용").collect()] == [("고용 동향 2024.03.11", "2024-03-11", "/v?id=3")]
    posts = spark.createDataFrame([("s", "2024-01", 2, "b"), ("s", "2024-01", 1, "a")], "source string, period string, page int, url string")
    assert files.first_per_period(posts, "page").collect()[0].url == "a"
    items = spark.createDataFrame([("b", p, f"{p}{k}", f"2024-0{5 - p}-01") for p in (1, 2, 3, 4) for k in "xy"], "board string, page int, id string, date string")
    known = spark.createDataFrame([("b", "1x"), ("b", "3x"), ("b", "3y")], "board string, id string")
    assert sorted(r.id for r in files.crawl(items, known, "2024-01-01").collect()) == ["1y", "2x", "2y"]
    assert sorted(r.id for r in files.crawl(items, known, "2024-04-01").collect()) == ["1y"]
    rows = spark.createDataFrame([("0", "계", "T1", "202401", "1,234,567"), ("0", "계", "T1", "202402", "-")], "C1 string, C2_NM string, ITM_ID string, PRD_DE string, DT string")
    assert [(r.period, r.value) for r in files.series_of_rows(rows, "est").collect()] == [("2024-01", 1234.6), ("2024-02", None)]


def test_office_files(spark, tmp_path):
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c></row><row r="4"><c r="AB4" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="표1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><r><t>구</t></r><r><t>분</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert sorted((r.sheet, r.row, r.col, r.value) for r in office.read_sheets(spark, str(tmp_path / "b.xlsx")).collect()) == [("표1", 1, 0, "구분"), ("표1", 1, 2, "3.5"), ("표1", 4, 27, "in")]
    p = lambda t: f"<p><run><t>{t}</t></run></p>"
    cell = lambda x: f"<tc>{x}</tc>"
    inner = f"<p><run><tbl><tr>{cell(p('inner'))}</tr></tbl></run></p>"
    with zipfile.ZipFile(tmp_path / "d.hwpx", "w") as z:
        z.writestr("Contents/section10.xml", f'<sec xmlns="h">{p("last")}</sec>')
        z.writestr("Contents/section2.xml", f'<sec xmlns="h">{p("first")}<p><run><tbl><tr>{cell(p("a"))}{cell(p("b") + inner)}</tr></tbl></run></p>{p("second")}</sec>')
    found = office.read_paragraphs(spark, str(tmp_path / "d.hwpx")).orderBy("section", "k").collect()
    assert [(r.section, r.k, r.text) for r in found] == [(2, 0, "first"), (2, 1, "a"), (2, 2, "b"), (2, 3, "inner"), (2, 4, "second"), (10, 0, "last")]
    assert sorted((r.tab, r.row, r.col, r.value) for r in office.read_document_tables(spark, str(tmp_path / "d.hwpx")).collect()) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (1, 0, 0, "inner")]


def test_sheets_are_those_that_the_workbook_names(spark, tmp_path):
    cell = lambda v: f'<worksheet xmlns="m"><sheetData><row r="2"><c r="B2"><v>{v}</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:  # sheet1 was deleted, and the two others change places
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="one" sheetId="3" r:id="rId7"/><sheet name="two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId2" Target="worksheets/sheet2.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet3.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet2.xml", cell(2))
        z.writestr("xl/worksheets/sheet3.xml", cell(3))
    assert sorted((r.sheet, r.row, r.col, r.value) for r in office.read_sheets(spark, str(tmp_path / "b.xlsx")).collect()) == [("one", 2, 1, "3"), ("two", 2, 1, "2")]
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="s"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>漢</t><rPh><t>かん</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert [r.value for r in office.read_sheets(spark, str(tmp_path / "c.xlsx")).collect()] == ["漢"]


def test_paragraphs_of_cells_stay_apart(spark, tmp_path):
    p = lambda *t: "<p>" + "".join(f"<run><t>{x}</t></run>" for x in t) + "</p>"
    box = f"<p><run><t>around</t><tbl><tr><tc>{p('27만 8', '천명')}{p('second  line')}</tc><tc><run><t>loose</t></run><run><t>text</t></run></tc></tr></tbl></run></p>"
    with zipfile.ZipFile(tmp_path / "d.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", f'<sec xmlns="h">{p("head")}{box}{p(" ")}</sec>')
    found = office.read_paragraphs(spark, str(tmp_path / "d.hwpx")).orderBy("k").collect()
    assert [r.text for r in found] == ["head", "around", "27만 8천명", "second line"]
    assert sorted((r.row, r.col, r.value) for r in office.read_document_tables(spark, str(tmp_path / "d.hwpx")).collect()) == [(0, 0, "27만 8천명 second line"), (0, 1, "loose text")]


def test_pages_are_read_when_asked_for(spark, tmp_path):
    for n in "ab":
        put(tmp_path / f"{n}.txt", f"{n} one\f{n} two")
    opened = []

    def pages(spark, documents):
        paths = [r.path for r in documents.collect()]
        opened.extend(paths)
        whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.posexplode(F.split("value", "\f")).alias("i", "text"))
        return whole.select("name", (F.col("i") + 1).alias("page"), "text")

    sources = DocumentSources()
    sources.register("notes", lambda s: s.createDataFrame([(n, str(tmp_path / f"{n}.txt")) for n in "ab"], "title string, path string"), pages)
    d = sources.documents(spark, "notes")
    assert d.count() == 2 and not opened
    assert sorted((r.name, r.page, r.text) for r in sources.pages(spark, "notes", d.where("title = 'b'")).collect()) == [("b.txt", 1, "b one"), ("b.txt", 2, "b two")] and len(opened) == 1
    with pytest.raises(ValueError, match="twice"):
        sources.register("notes", lambda s: d, pages)


def test_collectors_fail_alone(spark):
    c = Collectors()
    c.register("good")(lambda s, today: s.range(3))
    c.register("bad")(lambda s, today: 1 / 0)
    rows, manifest = c.run(spark, "2024-01-01")
    assert rows.count() == 3 and {r.name: (r.ok, r.fetched) for r in manifest.collect()} == {"good": (True, 3), "bad": (False, 0)}


def test_projection(spark):
    df = project(spark.createDataFrame([("1", "2", 3)], "id string, ts string, extra int").withColumn("ts", F.lit("2024-01-01")), "hit")
    assert df.columns == columns("hit") and df.dtypes[0] == ("id", "bigint") and set(TABLES) >= {"hit", "visitor", "report"}


def test_sorted_and_sharded(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"), (F.col("id") % 3).alias("org"), F.lit("long").alias("abstract"))
    tables.save_sorted(df.repartition(5), str(tmp_path / "o"), ["k"])
    lines = [json.loads(x)["k"] for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 100
    tables.save_shards(df, str(tmp_path / "s"), "org", ["abstract"])
    tables.save_shards(df.where("org < 2"), str(tmp_path / "s"), "org")
    assert sorted(p.name for p in (tmp_path / "s").glob("org=*")) == ["org=0", "org=1"]


def test_versions(spark, tmp_path):
    t = tables.Versions(spark, str(tmp_path / "t"))
    schema = "id string, value double, released string"
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert t.read(schema).count() == 0 and t.write(df(("a", 1.0, "1"), ("b", 1.0, "1"))) and not t.write(df(("b", 1.0, "1"), ("a", 1.0, "1")))
    with pytest.raises(ValueError, match="lost"):
        t.write(df(("a", 2.0, "1")), ["id"])
    assert t.upsert(df(("a", 2.0, "2"), ("c", 1.0, "1"), ("b", 9.0, "0")), "id", "released", ["value"]) == {"updated": 1, "added": 1, "rejected": 1} and t.newest().version == 2
    assert {r.id: r.value for r in t.read(schema).collect()} == {"a": 2.0, "b": 1.0, "c": 1.0}


def test_beacons(spark):
    body = lambda **x: json.dumps({"domain": "press", "path": "#/a/12/k=1", "visitor": "v", "session": "s", "ref": "https://www.google.com/q"} | x)
    rows = [(1, body(), "Mozilla iPhone Mobile"), (2, body(), "Googlebot"), (3, "{", "Mozilla"), (4, body(domain="other"), "Mozilla"), (5, body(visitor="x" * 65), "Mozilla"), (6, body(ref=None), "Mozilla")]
    b = spark.createDataFrame(rows, "id long, body string, ua string").withColumns({"ts": F.to_timestamp(F.lit("2024-01-01 15:30:00")), "country": F.lit("KR")})
    got = {r.id: r for r in beacons.hits_of(b, ["press"]).collect()}
    assert set(got) == {1, 6} and (got[1].path, got[1].day, got[1].ref, got[1].ref_kind, got[1].device) == ("/a/:id/k=:id", "2024-01-02", "google.com", "search", "mobile") and got[6].ref_kind == "direct"


def test_state_over_batches(spark, tmp_path):
    schema = "id long, ts timestamp, day string, visitor string"
    src = tmp_path / "in"
    for rows in ([[(1, None, "2024-01-01", "a"), (2, None, "2024-01-01", "a"), (3, None, "2024-01-01", "b")], [(4, None, "2024-01-01", "a"), (5, None, "2024-01-02", "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {r.id: (r.kept, r.hits, r.first_day) for r in beacons.drain(beacons.visitor_stream(stream, 2), spark).collect()}
    assert sum(k for k, _, _ in got.values()) == 4 and max(h for _, h, _ in got.values()) == 4 and {f for _, _, f in got.values()} == {"2024-01-01"}
    assert got[3] == (True, 1, "2024-01-01")


def test_late_hits_count_towards_their_own_day(spark, tmp_path):
    schema = "id long, ts timestamp, day string, visitor string"
    src = tmp_path / "in"
    day = lambda d: f"2024-01-{d:02d}"
    rows_of = lambda *rows: [(i, datetime.datetime(2024, 1, d, 3), day(d), v) for i, d, v in rows]
    batches = [(1, 5, "a")], [(k, 4, "a") for k in range(2, 6)], [(6, 5, "a")], [(10 + d, d, "a") for d in range(6, 12)], [(30, 4, "a"), (31, 11, "a"), (32, 11, "b")]
    for rows in batches:
        spark.createDataFrame(rows_of(*rows), schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {r.id: r for r in beacons.drain(beacons.visitor_stream(stream, 1, late="20 days"), spark).collect()}
    assert len(got) == sum(map(len, batches)) and max(r.hits for r in got.values()) == 14
    kept = [(r.visitor, r.day) for r in got.values() if r.kept]
    assert len(set(kept)) == len(kept)  # one a day at most, late days too
    assert sum(got[k].kept for k in range(2, 6)) == 1 and got[31].kept + got[21].kept == 1 and got[32].kept and {r.first_day for r in got.values() if r.id in (16, 30)} == {day(4)}


def test_state_is_given_up_48_hours_after_the_day(spark, tmp_path):
    schema, src, saved = "id long, ts timestamp, day string, visitor string", tmp_path / "in", str(tmp_path / "checkpoint")
    rows = lambda *r: spark.createDataFrame([(i, datetime.datetime(2024, 1, d, 3), f"2024-01-{d:02d}", v) for i, d, v in r], schema).coalesce(1).write.mode("append").parquet(str(src))
    out = []

    def run(visitor_kept):
        stream = spark.readStream.schema(schema).parquet(str(src))
        made = beacons.visitor_stream(stream, 1, late="1 hour", visitor_kept=visitor_kept)
        made.writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", saved).trigger(availableNow=True).start().awaitTermination()
        days = spark.read.format("statestore").option("path", saved).option("stateVarName", "days").load().collect()
        summary = spark.read.format("statestore").option("path", saved).option("stateVarName", "summary").load().collect()
        return {(r.key.visitor, r.user_map_key.day) for r in days}, {r.key.visitor for r in summary}

    week = datetime.timedelta(days=7)
    rows((1, 1, "a"), (2, 2, "a"), (3, 2, "b"))
    assert run(week) == ({("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-02")}, {"a", "b"})
    rows((4, 4, "c"))  # 3 January, 15:00 UTC ends a's first day's 48 hours
    assert run(week) == ({("a", "2024-01-02"), ("b", "2024-01-02"), ("c", "2024-01-04")}, {"a", "b", "c"})
    rows((5, 20, "c"))
    assert run(week) == ({("c", "2024-01-20")}, {"c"})
    assert sorted((r.id, r.kept, r.hits) for r in out) == [(1, True, 1), (2, True, 2), (3, True, 1), (4, True, 1), (5, True, 2)]


def test_snapshots_merge_once(spark, tmp_path):
    schema, src = "id string, value double, released string", tmp_path / "in"
    for rows in ([("a", 1.0, "1"), ("c", 1.0, "1"), ("c", 3.0, "1")], [("a", 2.0, "2"), ("b", 1.0, "1"), ("b", 1.0, "1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))  # one batch holds a key several times
    for _ in range(2):
        beacons.merge_snapshots(stream, spark, str(tmp_path / "t"), str(tmp_path / "c"), "id", "released", ["value"]).awaitTermination()
    t = tables.Versions(spark, str(tmp_path / "t"))
    assert t.newest().version == 1 and {r.id: r.value for r in t.read(schema).collect()} == {"a": 2.0, "b": 1.0, "c": 3.0} and t.read(schema).count() == 3
    batch = spark.createDataFrame([("a", 9.0, "9")], schema)
    assert t.upsert(batch, "id", "released", ["value"], batch=0) == {}  # a batch that ran already
    assert t.upsert(batch, "id", "released", ["value"], batch=1) == {"updated": 1, "kept": 2} == dict(t.newest().counts)
    assert t.upsert(batch, "id", "released", ["value"]) == {"unchanged": 1, "kept": 2}


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    one, other = tables.Versions(spark, str(tmp_path / "t")), tables.Versions(spark, str(tmp_path / "t"))
    one.write(spark.createDataFrame([("a", 1)], "id string, v int"))
    before = other.newest()
    one.write(spark.createDataFrame([("a", 2)], "id string, v int"))
    monkeypatch.setattr(other, "newest", lambda: before)
    with pytest.raises(Exception, match="(?i)exist"):
        other.write(spark.createDataFrame([("a", 3)], "id string, v int"))
    assert one.newest().version == 2 and one.read("id string, v int").first().v == 2


@pytest.mark.parametrize("limits", [(60, None), (60, 3), (1, None), (10_000, None), (10_000, 7)])
def test_pieces_are_those_of_one_pass(spark, limits):
    rng = random.Random(str(limits))
    rows = [(i, "x" * rng.choice([0, 1, 5, 30, 59, 80]), rng.choice([None, "é"])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, t string, u string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.id: r.piece for r in packing.pieces(df, ["t", "u"], ["id"], *limits, row_bytes=3).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    piece, size, n, want = 0, 0, 0, {}
    for i, t, u in rows:
        b = len(t.encode()) + len((u or "").encode()) + 3
        if n and (size + b > limits[0] or n >= (limits[1] or 1 << 60)):
            piece, size, n = piece + 1, 0, 0
        size, n, want[i] = size + b, n + 1, piece
    assert got == want
    assert packing.pieces(df.limit(0), ["t"], ["id"]).count() == 0
