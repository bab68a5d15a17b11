"""Every registered query against its SQL in DuckDB."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from postpulse.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = ordered(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = ordered(tuple(r[i] for i in places) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["audience", "part", "name", "ts", "n"] and df.count() > 0


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql()) <= set(entry.oracle_sql())


def test_every_operator_is_covered():
    families = {"S": 12, "K": 5, "P": 9, "F": 13, "J": 4, "A": 14, "W": 2, "T": 4, "U": 4,
                "N": 7, "R": 6, "G": 4}
    operators = {f"{f}{i}" for f, count in families.items() for i in range(1, count + 1)} | {"F1a"}
    covered = {op for ops in catalog.coverage().values() for op in ops}
    assert covered == operators
