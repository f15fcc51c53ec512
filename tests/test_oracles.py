"""Every registered query of the market part, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from tapelab.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    cell = lambda x: ("nan" if math.isnan(x) else repr(x + 0.0)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert norm(got) == norm([tuple(x[i] for i in at) for x in r.fetchall()])


def test_rows_only_queries_run(spark):
    for name in sorted(QUERIES.keys() - ORACLES.keys()):
        assert QUERIES[name](spark, SF).count() > 0, name
