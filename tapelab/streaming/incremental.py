"""Incremental and streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aggregates():
    at = F.struct("ts", "event_id")
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("transactions")]


def batch_bars(ticks: DataFrame, span: str) -> DataFrame:
    """Bars of fixed spans of time: ticker, start, open, high, low, close, transactions."""
    g = ticks.groupBy("ticker", F.window("ts", span)).agg(*_aggregates())
    return g.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "transactions")


def stream_bars(ticks: DataFrame, span: str, late: str) -> DataFrame:
    """As :func:`batch_bars` on a stream, for append mode: a bar comes once, when its span is ``late`` behind the newest row, and its state is dropped."""
    return batch_bars(ticks.withWatermark("ts", late), span)


def stream_dedupe(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_trailing(news: DataFrame, late: str) -> DataFrame:
    """Mean and count of the sentiment of the last 24 hours, at each hour, per ticker.

    Hours are summed first and the 24 hours are made of hours, so that a row is kept once and not in 24 windows.
    """
    hours = news.withWatermark("ts", late).groupBy("ticker", F.window("ts", "1 hour")).agg(F.sum("sentiment").alias("s"), F.count("sentiment").alias("c"), F.count(F.lit(1)).alias("n"))
    day = hours.groupBy("ticker", F.window(F.window_time("window"), "24 hours", "1 hour").alias("day")).agg((F.sum("s") / F.sum("c")).alias("mean_24h"), F.sum("n").alias("n_24h"))
    return day.select("ticker", F.col("day.end").alias("at"), "mean_24h", "n_24h")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its result; for tests and small result tables."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def append_since(rows: DataFrame, stored: DataFrame, by: str, time: str) -> DataFrame:
    """Rows strictly after the newest stored time of their key; all rows of a key that isn't stored yet."""
    mark = stored.groupBy(by).agg(F.max(time).alias("__mark"))
    return rows.join(mark, by, "left").filter(F.col("__mark").isNull() | (F.col(time) > F.col("__mark"))).drop("__mark")
