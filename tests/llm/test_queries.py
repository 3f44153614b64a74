"""The registered queries with an oracle against it, on the smallest tables."""

import math

import duckdb
import pytest

from methspark.llm import queries

TABLES = ("documents", "pages", "benchmark")


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_oracle(spark, tiny, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    got = queries.QUERIES[name](spark, tiny)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(x) for x in row) for row in found.fetchall()), key=str)
    assert sorted((tuple(plain(row[c]) for c in names) for row in got.collect()), key=str) == want
