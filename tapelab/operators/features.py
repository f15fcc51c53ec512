"""Point-in-time features of bars. Each looks at its own row and rows before it; rolling ones need a full window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators.windows import W, frame, full, last_n, rank_in_key, ret


def returns(bars: DataFrame, spans=(5, 10, 21, 63, 126, 252)) -> DataFrame:
    return bars.select("ticker", "date", *(ret("close", n).alias(f"ret_{n}") for n in spans))


def sma(n: int, col: str = "close") -> Column:
    return full(F.avg, col, n)


def sma_cross(fast: int, slow: int) -> Column:
    return F.try_divide(sma(fast) - sma(slow), sma(slow))


def trend_flag(n: int) -> Column:
    """1.0 above the mean of n bars, else 0.0; without a mean 0.0."""
    return F.coalesce((F.col("close") > sma(n)).cast("double"), F.lit(0.0))


def volatility(ret_col: str, n: int) -> Column:
    return full(F.stddev_samp, ret_col, n)


def rsi(change_col: str, n: int) -> Column:
    """By simple means; null without a loss."""
    gain = full(F.avg, F.greatest(F.col(change_col), F.lit(0.0)), n)
    loss = full(F.avg, F.greatest(-F.col(change_col), F.lit(0.0)), n)
    known = F.count(change_col).over(last_n(n)) == n
    return F.when(known, 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)))


def true_range(prev: str = "prev_close") -> Column:
    """High less low where there is no previous close."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(prev)), F.abs(F.col("low") - F.col(prev)))


def zscore(col: str, n: int, rows=None) -> Column:
    return F.try_divide(F.col(col) - full(F.avg, col, n, rows), full(F.stddev_samp, col, n, rows))


def drawdown(n: int) -> Column:
    return 1 - F.try_divide(F.col("close"), full(F.max, "high", n))


def rise_from_low(n: int) -> Column:
    return F.try_divide(F.col("close"), full(F.min, "low", n)) - 1


def bars_since_high(n: int) -> Column:
    """Bars since the highest high of n bars; of equal highs the oldest."""
    at = F.max(F.struct(F.col("high"), (-F.col("nth")).alias("k"))).over(last_n(n))
    return F.when(F.count("high").over(last_n(n)) == n, F.col("nth") + at["k"])


def ratio(col: str, short: int, long: int) -> Column:
    return F.try_divide(full(F.avg, col, short), full(F.avg, col, long))


def with_basics(bars: DataFrame) -> DataFrame:
    """nth, prev_close, change, ret_1 and dollar volume on every bar, from one ordering."""
    prev = F.lag("close").over(W())
    return bars.withColumns({"nth": rank_in_key(), "prev_close": prev}).withColumns({"change": F.col("close") - F.col("prev_close"), "ret_1": F.try_divide(F.col("close"), F.col("prev_close")) - 1, "dollar": F.col("close") * F.col("volume")})


def segments(bars: DataFrame, max_jump: float) -> DataFrame:
    """``segment``: how many day-to-day jumps beyond the factor came before or at this bar."""
    r = F.try_divide(F.col("close"), F.lag("close").over(W()))
    jump = F.coalesce(((r > max_jump) | (r < 1 / max_jump)).cast("int"), F.lit(0))
    return bars.withColumn("jump", jump).withColumn("segment", F.sum("jump").over(frame(Window.unboundedPreceding, 0))).drop("jump")


def smooth(bars: DataFrame, n: int) -> DataFrame:
    """``smoothed``: median of the last n closes of the same segment, of fewer at its beginning."""
    w = Window.partitionBy("ticker", "segment").orderBy("date").rowsBetween(-(n - 1), 0)
    return bars.withColumn("smoothed", F.percentile("close", F.lit(0.5)).over(w))
