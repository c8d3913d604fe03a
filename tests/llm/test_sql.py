"""The operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from pagestrata.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    frame = queries.queries()[name](spark, data)
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    rows = lambda found, names: sorted("|".join(plain(r[names.index(c)]) for c in sorted(names)) for r in found)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(result.fetchall(), columns)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
