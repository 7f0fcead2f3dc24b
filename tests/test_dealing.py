"""Plans that sort a table in tasks deal it into partitions that grow in number with its rows."""

import re

import pytest

from haneul import plans
from haneul.functions import dealing


@pytest.mark.parametrize("name", ["c24_tables_in_order", "k33_nearest_columns"])
def test_partitions_grow_with_the_rows(spark, sf, monkeypatch, name):
    monkeypatch.setattr(dealing, "ROWS", 100)
    parts = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert parts > 50
    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan)
    assert exchanges and set(exchanges) == {("l_orderkey", str(parts))}  # and nothing is shuffled after that
