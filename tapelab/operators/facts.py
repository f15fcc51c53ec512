"""Reported facts to quarters, stages and valuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earliest_filed(facts: DataFrame) -> DataFrame:
    """One row per period: the value that was filed first, so later restatements don't count."""
    return facts.groupBy("ticker", "start_date", "end_date").agg(F.min_by("val", "filed").alias("val"))


def discrete_quarters(facts: DataFrame) -> DataFrame:
    """ticker, end_date, val: periods of 80 to 100 days; where a fiscal year (350 to 380 days) holds exactly three of them,
    its fourth by subtraction. The quarters inside a year are found by the year that each one's end falls in, one window pass."""
    e = earliest_filed(facts).withColumn("days", F.datediff("end_date", "start_date"))
    q = e.filter("days between 80 and 100").select("ticker", "end_date", "val")
    y = e.filter("days between 350 and 380").select("ticker", F.col("start_date").alias("y_start"), F.col("end_date").alias("y_end"), F.col("val").alias("y_val"))
    # a quarter's end lies in at most a few fiscal years: join on the calendar years that the fiscal year touches
    yy = y.withColumn("cal", F.explode(F.sequence(F.year("y_start"), F.year("y_end"))))
    inside = q.withColumn("cal", F.year("end_date")).join(yy, ["ticker", "cal"]).filter("end_date > y_start and end_date < y_end")
    q4 = inside.groupBy("ticker", "y_end").agg((F.max("y_val") - F.sum("val")).alias("val"), F.count(F.lit(1)).alias("n")).filter("n = 3").select("ticker", F.col("y_end").alias("end_date"), "val")
    return q.unionByName(q4.join(q.select("ticker", "end_date"), ["ticker", "end_date"], "left_anti"))


def difference_cumulative(facts: DataFrame) -> DataFrame:
    """ticker, end_date, val: year-to-date values less the one before with the same start."""
    w = Window.partitionBy("ticker", "start_date").orderBy("end_date")
    return earliest_filed(facts).select("ticker", "end_date", (F.col("val") - F.coalesce(F.lag("val").over(w), F.lit(0))).alias("val"))


def with_stage(quarters: DataFrame) -> DataFrame:
    """``stage``: 0 without revenue, 1 without profit, 2 without free cash flow, else 3; a missing value isn't positive."""
    positive = lambda c: F.coalesce(c > 0, F.lit(False))
    stage = F.when(~positive(F.col("revenue")), 0).when(~positive(F.col("net_income")), 1).when(~positive(F.col("operating_cf") - F.col("capex")), 2).otherwise(3)
    return quarters.withColumn("stage", stage)


def crossing(staged: DataFrame, before: int = 4, share: float = 0.75, max_prior: int = 0, after: int = 2, least_after: int = 2, last_stage: int = 3, wobbles: int = 1) -> DataFrame:
    """ticker, crossing: the first quarter at stage 3 after losses that lasts, by frames before and after it."""
    w = Window.partitionBy("ticker").orderBy("end_date")
    past, four, future = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-before, -1), w.rowsBetween(1, Window.unboundedFollowing)
    t = staged.withColumns({
        "before_n": F.count(F.lit(1)).over(past), "low": F.count_if(F.col("stage") <= 1).over(four), "prior": F.coalesce(F.sum("net_income").over(past), F.lit(0)),
        "after_n": F.count(F.lit(1)).over(future), "least": F.min("stage").over(future), "last": F.last("stage").over(future), "twos": F.count_if(F.col("stage") == 2).over(future),
    })
    ok = (F.col("stage") == 3) & (F.col("before_n") >= before) & (F.col("low") >= share * before) & (F.col("prior") <= max_prior) & (F.col("after_n") >= after) & (F.col("least") >= least_after) & (F.col("last") >= last_stage) & (F.col("twos") <= wobbles)
    return t.filter(ok).groupBy("ticker").agg(F.min("end_date").alias("crossing"))


def failures(staged: DataFrame, never: int = 3, tail: int = 8, max_tail: int = 0, max_ratio: float = 0.1) -> DataFrame:
    """ticker, ratio (revenue over losses) of those that never reached stage ``never``, had some revenue, lost money, and ended without profit."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("end_date")))
    rev, loss = F.sum(F.greatest(F.col("revenue"), F.lit(0))), -F.sum(F.least(F.col("net_income"), F.lit(0)))
    g = staged.withColumn("back", back).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("stage").alias("top"), F.max("revenue").alias("some"), rev.alias("rev"), loss.alias("loss"), F.sum(F.when(F.col("back") <= tail, F.col("net_income"))).alias("tail"))
    return g.filter((F.col("n") >= 8) & (F.col("top") < never) & (F.col("some") > 0) & (F.col("loss") > 0) & (F.col("tail") <= max_tail) & (F.col("rev") <= max_ratio * F.col("loss"))).select("ticker", (F.col("rev").cast("double") / F.col("loss").cast("double")).alias("ratio"))


def price_to_sales(quarters: DataFrame, bars: DataFrame, splits: DataFrame, shares: int = 1_000_000) -> DataFrame:
    """ticker, end_date, ps: last close strictly before the end, times later split ratios, times shares, over four quarters' revenue."""
    from tapelab.operators.asof import asof_join

    w = Window.partitionBy("ticker").orderBy("end_date").rowsBetween(-3, 0)
    t = quarters.select("ticker", "end_date", F.when(F.count(F.lit(1)).over(w) == 4, F.sum("revenue").over(w).cast("double")).alias("ttm"))
    priced = asof_join(t, bars.select("ticker", "date", "close"), "ticker", "end_date", "date", inclusive=False)
    later = asof_join(priced.select("ticker", "end_date", "ttm", F.col("match.close").alias("close")), splits.withColumn("f", F.product("ratio").over(Window.partitionBy("ticker").orderBy("split_date").rowsBetween(0, Window.unboundedFollowing))), "ticker", "end_date", "split_date", "forward", inclusive=False)
    return later.select("ticker", "end_date", F.try_divide(F.col("close") * F.coalesce(F.col("match.f"), F.lit(1.0)) * shares, F.col("ttm")).alias("ps"))


def runway_band(flow: Column, cash: Column) -> Column:
    burn = -flow
    return F.when(flow >= 0, "40-100").when(cash.isNull(), "0-40").when(cash < 4 * burn, "0-25").when(cash < 8 * burn, "10-45").when(cash < 16 * burn, "25-65").otherwise("40-80")
