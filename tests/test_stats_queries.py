"""Counts of customers without orders against the queries' SQL."""

import os

import duckdb
import pytest

from tracelake.operators import stats
from tracelake.plans import catalog

CUSTOMERS = "SELECT unnest([1, 2, 3]) AS c_custkey"
ORDERS = "SELECT * FROM (VALUES (10, 1, 'F'), (11, 1, 'O'), (12, 2, 'F')) t (o_orderkey, o_custkey, o_orderstatus)"
LINES = "SELECT * FROM (VALUES (10, 5, 1, 'R'), (11, 6, 1, 'N'), (12, 5, 1, 'N')) t (l_orderkey, l_partkey, l_linenumber, l_returnflag)"


@pytest.mark.parametrize("name", ["totals_rollup", "requirement_stats"])
def test_customers_without_orders(spark, tmp_path, name):
    duck = duckdb.connect()
    for table, made in (("customer", CUSTOMERS), ("orders", ORDERS), ("lineitem", LINES)):
        duck.execute(f"COPY ({made}) TO '{tmp_path}/{table}.parquet'")
        duck.execute(f"CREATE VIEW {table} AS FROM '{os.path.join(tmp_path, table)}.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


#: A customer thrice and one without key; orders without customer, key or status; lines without order or flag.
ODD = {
    "customer": "SELECT unnest([1, 1, 1, 2, 3, 4, 5, 6, NULL, NULL]) AS c_custkey",
    "orders": """SELECT * FROM (VALUES (10, 1, 'F'), (11, 1, 'O'), (12, 2, NULL), (13, 4, NULL), (14, 4, 'F'), (15, NULL, 'F'), (NULL, 5, 'F'), (16, 6, NULL), (17, 6, NULL))
        t (o_orderkey, o_custkey, o_orderstatus)""",
    "lineitem": """SELECT * FROM (VALUES (10, 5, 1, 'R'), (10, 6, 2, 'A'), (11, 6, 1, 'N'), (12, 5, 1, 'A'), (13, 5, 1, 'A'), (14, 5, 1, 'N'), (14, 5, 2, NULL), (15, 7, 1, 'R'), (NULL, 7, 1, 'R'), (16, 7, 1, 'R'))
        t (l_orderkey, l_partkey, l_linenumber, l_returnflag)""",
}


@pytest.mark.parametrize("name", ["totals_rollup", "requirement_stats"])
def test_repeated_customers_and_nulls(spark, tmp_path, name):
    duck = duckdb.connect()
    for table, made in ODD.items():
        duck.execute(f"COPY ({made}) TO '{tmp_path}/{table}.parquet'")
        duck.execute(f"CREATE VIEW {table} AS FROM '{os.path.join(tmp_path, table)}.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_operator_counts_zeros(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "doc string")
    made = [("1", "a", True, ["x"]), ("2", "a", None, ["x"]), ("3", "a", True, []), ("4", "b", None, ["x"])]
    got = stats.requirement_stats(docs, spark.createDataFrame(made, "id string, doc string, isReviewed boolean, codeRanges array<string>"))
    assert sorted(map(tuple, got.collect())) == [("a", 3, 2, 1, 1), ("b", 1, 1, 0, 0), ("c", 0, 0, 0, 0)]
