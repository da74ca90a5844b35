"""Every registered query against its SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

from mediaops.plans.catalog import QUERIES  # noqa: E402

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="sample tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, sql, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = sql.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    columns = sorted(df.columns)
    assert columns == sorted(kinds)
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    order = [list(kinds).index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=key)
    assert mine == theirs


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["rule_ix", "cmd", "files"] and df.count() == 5
