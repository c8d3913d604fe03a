"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pagestrata.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def lines(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, data, con, name):
    frame = registry.queries()[name](spark, data)
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert lines([tuple(r) for r in frame.collect()], frame.columns) == lines(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
