"""Every query with an oracle against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from lumenfield import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 6) + 0.0:.6f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{small}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, small, name):
    df = q.QUERIES[name](spark, small)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in q.ORACLES:
        r = duck.execute(q.ORACLES[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, r.fetchall())
    else:
        assert got


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_partitioning_changes_nothing(spark, small):
    before = rows(["residue_index", "q"], [(r.residue_index, r.q_bh) for r in q.QUERIES["bh_table"](spark, small).collect()])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert before == rows(["residue_index", "q"], [(r.residue_index, r.q_bh) for r in q.QUERIES["bh_table"](spark, small).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
