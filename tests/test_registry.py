"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from jobloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, con, name):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(str, con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()))
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "id"
    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
