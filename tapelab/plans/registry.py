"""The registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapelab.sources.tables import duckdb_sql, load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of DataFrames as the query ``name`` over ``tables``; ``sql`` is its text for DuckDB over the same tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(load(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql, *tables)
        return f

    return add


from tapelab.plans import aggregates, evidence, features, flagship, fundamentals, incremental, joins, labels, projections, statistics, text, valuation, walkforward, whole  # noqa: E402, F401
