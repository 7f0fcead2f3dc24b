"""Plans give DuckDB's rows on rows that the small tables lack."""

from datetime import datetime

import duckdb
import pytest
from test_plans import SQL, rows

from haneul import plans


@pytest.fixture
def same(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for table, (values, ddl) in tables.items():
            spark.createDataFrame(values, ddl).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = plans.queries()[name](spark, str(tmp_path))
        made = con.execute(SQL[name])
        names, columns = [d[0] for d in made.description], sorted(df.columns)
        want = rows(made.fetchall(), columns, lambda r, c: r[names.index(c)])
        assert want and rows(df.collect(), columns, lambda r, c: r[c]) == want

    return check


ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"


@pytest.mark.parametrize("name", ["k18_figures", "m09_verify_answers"])
def test_answers_of_any_customer(same, name):
    same(name, orders=([(i, k, 1234.5 + i, datetime(1999, 7, 1)) for i, k in enumerate((7, 70, 1900, 2001, 2099, 7000, 12_000))], ORDERS))


def test_sizes_halfway_between_two_printed_ones(same):
    same("m19_domain_states", supplier=([(k,) for k in (36_864, 36_869, 4_099, 12_289, 20_484)], "s_suppkey long"))
