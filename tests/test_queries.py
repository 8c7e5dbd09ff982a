"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from deltaboard.plans import oracles, queries, stream_oracles, stream_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def all_queries():
    return queries.all_queries() | stream_queries.all_queries()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(oracles.all_sql() | stream_oracles.all_sql())
    assert set(all_queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    order = sorted(names)
    twin = sorted(tuple(repr(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(repr(r[c]) for c in order) for r in df.collect()) == twin


def test_entry(spark):
    assert entry.entry(spark).columns == ["naptan_id", "line_id", "direction", "pos", "feed_seq", "eta"]
