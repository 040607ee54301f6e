"""Runs that share timestamp and id are numbered by their place in the index, whatever order their rows are stored in."""

import duckdb
import pytest

from corvid.plans import stored  # noqa: F401 (registers its queries)
from corvid.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def tied(small, tmp_path):
    """Orders stored backwards, most of which share date and id with others."""
    duckdb.sql(f"""COPY (SELECT o_orderkey * 65536 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, date_trunc('year', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderpriority
      FROM '{small}/orders.parquet' ORDER BY o_orderkey DESC) TO '{tmp_path}/orders.parquet'""")
    return str(tmp_path)


def _same(spark, d, name):
    """The query equals its SQL with pos as the last key of the order, which the SQL itself leaves open."""
    sql = ORACLE_SQL[name]
    assert sql.count("ORDER BY timestamp, id)") == 1
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet'")
    want = con.sql(sql.replace("ORDER BY timestamp, id)", "ORDER BY timestamp, id, pos)"))
    df = QUERIES[name](spark, d)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_compared_runs(spark, tied):
    _same(spark, tied, "results_compare")


def test_run_numbers(spark, tied):
    _same(spark, tied, "results_run_numbers")


@pytest.mark.parametrize("name", ["results_compare", "results_run_numbers"])
def test_runs_without_time(spark, small, tmp_path, name):
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS o_orderdate) FROM '{small}/orders.parquet' ORDER BY o_orderkey DESC) TO '{tmp_path}/orders.parquet'")
    _same(spark, str(tmp_path), name)
