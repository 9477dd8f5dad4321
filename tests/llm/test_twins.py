"""Queries against their SQL twins, and all queries on the smallest tables."""

import duckdb
import pytest

from quire.llm.oracle import oracle_sql
from quire.llm.queries import queries
from tests.conftest import SMALL

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries()[name](spark, SMALL)
    relation = con.sql(oracle_sql()[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert types == {c: TYPES[t] for c, t in df.dtypes}
    columns = sorted(df.columns)
    order = [relation.columns.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert ours == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=key)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
