"""Every registered query against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

from methspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return tuple(plain(y) for y in x) if isinstance(x, list) else x


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, tiny, name):
    got = catalogue.QUERIES[name](spark, tiny)
    columns = sorted(got.columns)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=str)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in got.collect()), key=str) == want


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_without_oracle_runs(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


def test_the_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
