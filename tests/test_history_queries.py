"""Every history query against its SQL oracle on the smallest tables, and independence of partitioning."""

import glob
import os

import pytest

from annalspark.plans import history_queries as h
from annalspark.plans import model_queries  # noqa: F401  registers more

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(x):
    return str(int(x)) if isinstance(x, int | float) and float(x).is_integer() else repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(h.ORACLE_SQL))
def test_query_equals_oracle(spark, oracle, name):
    found = oracle.execute(h.ORACLE_SQL[name])
    assert spark_rows(h.QUERIES[name](spark, DATA)) == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["changesets_greedy", "changeset_confidence", "order_fix_misplaced", "snapshot_diff", "asof_lookup", "topo_order"])
def test_same_rows_for_any_partitioning(spark, name):
    out = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(spark_rows(h.QUERIES[name](spark, DATA)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]
