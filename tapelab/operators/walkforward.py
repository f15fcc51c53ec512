"""Walk-forward windows, equity curves and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelab.operators.stats import quantiles

MONTH = 30


def windows(spark: SparkSession, start: str, end: str, train: int, predict: int, gap: int) -> DataFrame:
    """window_id, train_start, train_end, predict_start, predict_end (half open), from months of 30 days; the step is the
    prediction span, and a window whose end lies behind ``end`` is not made."""
    base = spark.range(1).select(F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"))
    return windows_of(base, train, predict, gap)


def windows_of(span: DataFrame, train: int, predict: int, gap: int) -> DataFrame:
    """As :func:`windows`, over a row with start_date and end_date."""
    t, p = train * MONTH, predict * MONTH
    base = span.select(F.col("start_date").alias("s"), F.col("end_date").alias("e"))
    last = F.floor((F.datediff("e", "s") - t - gap - p) / p).cast("int")
    ids = base.select("s", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))).alias("window_id"))
    at = lambda n: F.date_add("s", F.col("window_id") * p + n)
    return ids.select("window_id", at(0).alias("train_start"), at(t).alias("train_end"), at(t + gap).alias("predict_start"), at(t + gap + p).alias("predict_end"))


def assign(rows: DataFrame, wins: DataFrame, date: str = "date") -> DataFrame:
    """Rows with window_id and role (train or predict). The windows are a few dozen rows by construction and are broadcast."""
    d = F.col(date)
    role = F.when((d >= F.col("train_start")) & (d < F.col("train_end")), "train").when((d >= F.col("predict_start")) & (d < F.col("predict_end")), "predict")
    return rows.join(F.broadcast(wins), (d >= F.col("train_start")) & (d < F.col("predict_end"))).withColumn("role", role).filter("role is not null")


def equity_curve(trades: DataFrame, by: list[str], order: list[str], ret: str = "ret") -> DataFrame:
    """``equity`` and ``drawdown``: the peak runs from the first equity value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    return t.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def net_equity(trades: DataFrame, by: list[str], order: list[str], capital: float, fee: float, ret: str = "ret") -> DataFrame:
    """``net_equity``: C (1 + r) - fee after each trade, in closed form P_n (C - sum of fee / P_k); needs 1 + r > 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("__p", F.product(1 + F.col(ret)).over(w))
    return t.withColumn("net_equity", F.col("__p") * (capital - F.sum(fee / F.col("__p")).over(w))).drop("__p")


def calibrate(train: DataFrame, predict: DataFrame, score: str, label: str, bins: int = 5) -> DataFrame:
    """``predict`` with ``rate``, the win rate of its bin, and ``size`` = 2 (rate - 0.5) kept in 0..1. Bins are cut at the training
    scores' quantiles, closed to the right; with fewer than three different edges there is one bin."""
    cuts = quantiles(train, score, [], **{f"q{k}": k / bins for k in range(1, bins)})
    edges = train.sparkSession.range(1).join(F.broadcast(cuts), how="left").select(F.array_distinct(F.array(*(f"q{k}" for k in range(1, bins)))).alias("edges"))
    edges = edges.select(F.when(F.size("edges") < 3, F.array().cast("array<double>")).otherwise(F.col("edges")).alias("edges"))
    bin_of = F.size(F.filter("edges", lambda e: e < F.col(score)))
    rates = train.join(F.broadcast(edges)).groupBy(bin_of.alias("bin")).agg(F.avg(label).alias("rate"))
    out = predict.join(F.broadcast(edges)).withColumn("bin", bin_of).drop("edges").join(F.broadcast(rates), "bin", "left")
    return out.withColumn("size", F.least(F.greatest(2 * (F.col("rate") - 0.5), F.lit(0.0)), F.lit(1.0)))
