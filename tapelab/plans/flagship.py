"""The flagship study, end to end: bars, features, ranked picks, barrier outcomes, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelab.operators.features import drawdown, rsi, with_basics
from tapelab.operators.outcomes import barrier_outcome
from tapelab.plans import sqltext as s
from tapelab.plans.registry import query
from tapelab.sources.tables import load


def picks(bars: DataFrame) -> DataFrame:
    """Every 21st bar with 63 before it, ranked by drawdown and RSI; the best tenth of each year."""
    t = with_basics(bars).withColumns({"drawdown": drawdown(63), "rsi": rsi("change", 14)})
    t = t.filter("nth > 63 and (nth - 1 - 63) % 21 = 0 and rsi is not null").withColumn("year", F.year("date"))
    w = Window.partitionBy("year")
    t = t.withColumns({"r": F.row_number().over(w.orderBy(F.round("drawdown", 9).desc(), "ticker", "date")), "n": F.count(F.lit(1)).over(w)})
    return t.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))).select("ticker", F.col("nth").alias("entry"), F.col("close").alias("base"), "year")


@query(
    "flagship_barrier_study", "bars",
    sql=f"""WITH {s.BASICS}, f AS (SELECT *, 1 - close / {s.full('max', 'high', 63)} AS drawdown, CASE WHEN count(change) OVER {s.over(-13, 0)} = 14 AND avg(greatest(-change, 0)) OVER {s.over(-13, 0)} > 0 THEN 1 END AS rsi FROM b),
        c AS (SELECT *, extract(YEAR FROM date) AS year FROM f WHERE nth > 63 AND (nth - 1 - 63) % 21 = 0 AND rsi IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(drawdown, 9) DESC, ticker, date) AS r, count(*) OVER (PARTITION BY year) AS n FROM c),
        p AS (SELECT ticker, nth AS entry, close AS base, year FROM k WHERE r <= greatest(1, floor(n / 10))),
        path AS (SELECT p.*, x.nth - p.entry AS k, x.open, x.high, x.low, x.close FROM p JOIN b AS x ON x.ticker = p.ticker AND x.nth BETWEEN p.entry + 1 AND p.entry + 63),
        hit AS (SELECT *, row_number() OVER (PARTITION BY ticker, entry ORDER BY k) AS h FROM path WHERE low <= base * 0.9 OR high >= base * 1.15),
        tail AS (SELECT ticker, entry, year, base, max_by(close, k) AS last_close, max(k) AS n FROM path GROUP BY 1, 2, 3, 4),
        o AS (SELECT t.year, CASE WHEN h.k IS NULL THEN CASE WHEN t.n < 63 THEN 'short' ELSE 'timeout' END WHEN h.low <= t.base * 0.9 THEN 'stop' ELSE 'target' END AS outcome,
              CASE WHEN h.k IS NULL THEN t.last_close WHEN h.low <= t.base * 0.9 THEN least(t.base * 0.9, h.open) ELSE greatest(t.base * 1.15, h.open) END / t.base - 1 AS ret FROM tail AS t LEFT JOIN hit AS h ON h.ticker = t.ticker AND h.entry = t.entry AND h.h = 1)
        SELECT CAST(year AS INTEGER) AS year, outcome, count(*) AS n, round(avg(ret), 5) AS mean_ret FROM o GROUP BY 1, 2""",
)
def study(bars: DataFrame) -> DataFrame:
    p = picks(bars)
    o = barrier_outcome(p.select("ticker", "entry", "base"), bars, 0.15, 0.1, 63)
    return o.join(p.select("ticker", "entry", "year"), ["ticker", "entry"]).groupBy("year", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 5).alias("mean_ret"))


def barrier_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(load(spark, sf_dir, "bars"))
