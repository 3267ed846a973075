"""Every query with SQL gives DuckDB's rows; those without it run and have a stable schema."""

import duckdb
import pytest

import __spark_entry__
from tests.conftest import DATA
from tracewarden.plans import catalogue

FOLDER = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_agree(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in got.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_the_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
