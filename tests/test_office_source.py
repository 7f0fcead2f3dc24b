"""The office data source: a partition for each sheet, filters that reach it, and files that arrive in a stream."""

import os

import pandas as pd
import pytest

from haneul.sinks import office as sink
from haneul.sources import office, office_source


@pytest.fixture
def folder(spark, tmp_path):
    office_source.register(spark)
    for name in "ab":
        _put(tmp_path / "in", name, ["one", "two", "three"])
    return tmp_path / "in"


def _put(folder, name, sheets, value="x"):
    folder.mkdir(exist_ok=True)
    cells = pd.DataFrame([(s, r, c, f"{value}{name}{s}{r}{c}") for s in sheets for r in (1, 4) for c in (0, 30)], columns=["sheet", "row", "col", "value"])
    (folder / f".{name}").write_bytes(sink.workbook(cells))
    os.rename(folder / f".{name}", folder / f"{name}.xlsx")


def test_a_sheet_is_a_partition(spark, folder):
    df = spark.read.format("office").load(str(folder))
    assert df.rdd.getNumPartitions() == 6
    by_file = {(r.path.rsplit("/", 1)[1], r.sheet, r.row, r.col): r.value for r in df.collect()}
    assert len(by_file) == 24 and by_file["b.xlsx", "two", 4, 30] == "xbtwo430"
    assert sorted(map(tuple, df.drop("path").collect())) == sorted(map(tuple, office.read_sheets(spark, str(folder)).drop("path").collect()))


def test_filters_choose_the_partitions(spark, folder):
    read = spark.read.format("office").load(str(folder))
    one = read.where("sheet = 'two'")
    assert one.rdd.getNumPartitions() == 2 and one.count() == 8
    some = read.where("sheet in ('two', 'three', 'none') and row = 1")
    assert some.rdd.getNumPartitions() == 4 and {(r.sheet, r.row) for r in some.collect()} == {("two", 1), ("three", 1)}
    assert read.where("sheet = 'none'").count() == 0
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("office").option("kind", "x").load(str(folder)).count()
    assert spark.read.format("office").option("kind", "tables").load(str(folder)).count() == 0


def test_new_files_arrive_once(spark, folder, tmp_path):
    got = []

    def run():
        stream = spark.readStream.format("office").load(str(folder))
        query = stream.writeStream.foreachBatch(lambda b, _: got.extend(r.value for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert len(got) == len(set(got)) == 24
    _put(folder, "late", ["one"], "y")
    run()
    run()
    assert len(got) == 28 and sorted(got)[-4:] == ["ylateone10", "ylateone130", "ylateone40", "ylateone430"]
