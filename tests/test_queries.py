"""Every registered query against its DuckDB form, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corvid.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _rows(names, rows):
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([number(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())


def test_metrics_stream_equals_batch(spark, small):
    rounded = lambda df: sorted((r.step, *(None if x is None else round(x, 9) for x in (r.train_loss, r.grad, r.val_loss, r.progress))) for r in df.collect())
    assert rounded(QUERIES["metrics_stream"](spark, small)) == rounded(QUERIES["metrics_curve"](spark, small))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
