"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from quire.plans.oracle import oracle_sql
from quire.plans.queries import queries
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def test_every_query_has_a_twin():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    relation = duck.sql(oracle_sql()[name])
    names, types = relation.columns, dict(zip(relation.columns, map(str, relation.types)))
    assert sorted(names) == columns
    assert {c: types[c] for c in columns} == {c: TYPES[t] for c, t in df.dtypes}
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=_key)
    assert ours == theirs
    assert ours


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "element_index", "line"]
    assert df.limit(1).count() == 1
