"""Every plan that has SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from haneul import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(values, columns, of):
    return sorted((tuple(plain(of(r, c)) for c in columns) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_equals_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    made = duck.execute(SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    assert rows(df.collect(), columns, lambda r, c: r[c]) == rows(made.fetchall(), columns, lambda r, c: r[names.index(c)])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["domain", "visitors", "sessions", "views"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_llm_package():
    import pathlib
    import re

    root = pathlib.Path(plans.__file__).parent.parent
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not [p for p in own if re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M)]


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plans.queries()["c03_value_ranges"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_extendedprice" not in plan
    plan = plans.queries()["m10_evidence_by_role"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan
