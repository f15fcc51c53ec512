"""Market values at announcements, rises since them, and best runs of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators.asof import asof_join

MONTHS = (6, 12, 24)


def diluted_shares(facts: DataFrame) -> DataFrame:
    """ticker, end_date, shares: per period end the quarterly count that was filed first, and the annual one only where there is no quarterly."""
    days = F.datediff("end_date", "start_date")
    first = lambda a, b: F.min_by("val", F.when(days.between(a, b), F.col("filed")))
    shares = F.coalesce(first(80, 100), first(350, 380))
    return facts.groupBy("ticker", "end_date").agg(shares.alias("shares")).filter("shares is not null")


def market_values(quarters: DataFrame, announced: DataFrame, bars: DataFrame, shares: DataFrame, splits: DataFrame, max_age_days: int = 120) -> DataFrame:
    """ticker, end_date, announced, close, mcap, ttm_revenue, ps, p_fcf of quarters with three before them.

    The price is the last close before the announcement, in units of that day (times all later split ratios); shares are the newest of
    the last ``max_age_days`` before the quarter's end. Ratios are null unless what they divide by is positive. Quarters
    without a price or shares have no row.
    """
    w = Window.partitionBy("ticker").orderBy("end_date").rowsBetween(-3, 0)
    full = lambda c: F.when(F.count(c).over(w) == 4, F.sum(c).over(w))
    t = quarters.withColumns({"ttm_revenue": full(F.col("revenue")), "ttm_fcf": full(F.col("operating_cf") - F.col("capex"))}).select("ticker", "end_date", "ttm_revenue", "ttm_fcf")
    t = t.filter("ttm_revenue is not null").join(announced.select("ticker", "end_date", "announced"), ["ticker", "end_date"])
    t = asof_join(t, shares.select("ticker", F.col("end_date").alias("as_of"), "shares"), "ticker", "end_date", "as_of")
    t = t.filter(F.datediff("end_date", "match.as_of") <= max_age_days).withColumn("shares", F.col("match.shares")).drop("match")
    t = asof_join(t, bars.select("ticker", "date", "close"), "ticker", "announced", "date", inclusive=False)
    t = t.filter("match is not null").withColumns({"close": F.col("match.close"), "priced": F.col("match.date")}).drop("match")
    later = splits.withColumn("f", F.product("ratio").over(Window.partitionBy("ticker").orderBy("split_date").rowsBetween(0, Window.unboundedFollowing)))
    t = asof_join(t, later.select("ticker", "split_date", "f"), "ticker", "priced", "split_date", "forward", inclusive=False)
    mcap = F.col("close") * F.coalesce(F.col("match.f"), F.lit(1.0)) * F.col("shares")
    over = lambda c: F.when(F.col(c) > 0, F.col("mcap") / F.col(c))
    return t.withColumn("mcap", mcap).select("ticker", "end_date", "announced", "close", "mcap", "ttm_revenue", over("ttm_revenue").alias("ps"), over("ttm_fcf").alias("p_fcf"))


def current_ps(values: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker, ps_now: the last announcement's price to sales times how much the price has moved since."""
    last = values.groupBy("ticker").agg(F.max_by(F.struct("ps", "close"), "end_date").alias("v"))
    now = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("latest"))
    return last.join(now, "ticker").select("ticker", F.when(F.col("v.close") > 0, F.col("v.ps") * F.col("latest") / F.col("v.close")).alias("ps_now"))


def weekly(bars: DataFrame, by: str = "ticker") -> DataFrame:
    """by, date (the week's last with a bar), close."""
    g = bars.groupBy(by, F.date_trunc("week", "date").alias("week")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return g.select(by, "date", "close")


def rise_since(events: DataFrame, series: DataFrame, by: str, known: str, name: str) -> DataFrame:
    """``events`` with ``name``: percent from the last close of ``series`` before the day ``known`` to its latest; null without one before."""
    latest = series.groupBy(F.col(by).alias("__by")).agg(F.max_by("close", "date").alias("__now"))
    j = asof_join(events, series.select(by, "date", "close"), by, known, "date", inclusive=False)
    j = j.join(latest, F.col(by) == F.col("__by"), "left")
    return j.withColumn(name, F.when(F.col("match.close") > 0, 100 * (F.col("__now") / F.col("match.close") - 1))).drop("match", "__by", "__now")


def relative_pct(own: Column, sector: Column) -> Column:
    return 100 * ((1 + own / 100) / (1 + sector / 100) - 1)


def forward_returns(rows: DataFrame, bars: DataFrame, by: str, as_of: str, months: tuple[int, ...] = MONTHS, within: int = 10) -> DataFrame:
    """``rows`` with ret_6m, ..., ret_now: percent from the close on or before ``as_of`` to the first close on or after as many months later
    (less than ``within`` days later), and to the latest; null where there is none."""
    b = bars.select(by, "date", "close")
    t = asof_join(rows, b, by, as_of, "date").withColumn("__base", F.col("match.close")).drop("match")
    for m in months:
        t = asof_join(t.withColumn("__to", F.add_months(as_of, m)), b, by, "__to", "date", "forward")
        hit = F.datediff("match.date", "__to") < within
        t = t.withColumn(f"ret_{m}m", F.when(hit, 100 * (F.col("match.close") / F.col("__base") - 1))).drop("match", "__to")
    latest = bars.groupBy(F.col(by).alias("__by")).agg(F.max_by("close", "date").alias("__now"))
    return t.join(latest, F.col(by) == F.col("__by"), "left").withColumn("ret_now", 100 * (F.col("__now") / F.col("__base") - 1)).drop("__base", "__by", "__now")


def best_run_by_segment(bars: DataFrame, multiple: float, n: int, min_price: float, min_dollar: float, smooth: int = 5, max_jump: float = 10.0) -> DataFrame:
    """Per ticker the best rise of smoothed closes within ``n`` bars, if it is ``multiple`` times at least (ties: earliest).

    A close more than ``max_jump`` times the one before, or less than its share, begins another segment, and no run goes across. Prices are running medians of ``smooth``
    closes of a segment. A start needs its close at ``min_price`` and the mean of close times volume of 20 bars (5 at least) at ``min_dollar``.
    Columns: ticker, start_date, start_price, peak_date, peak_price, multiple, days_to_peak, cross_date, last_price, last_vs_peak_pct, current_multiple.
    """
    by = Window.partitionBy("ticker").orderBy("date")
    ratio = F.col("close") / F.lag("close").over(by)
    t = bars.select("ticker", "date", "close", "volume", F.coalesce((ratio > max_jump) | (ratio < 1 / max_jump), F.lit(False)).cast("int").alias("jump"))
    t = t.withColumn("segment", F.sum("jump").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy("ticker", "segment").orderBy("date")
    last_20, ahead = seg.rowsBetween(-19, 0), seg.rowsBetween(1, n)
    t = t.withColumns({"p": F.percentile("close", F.lit(0.5)).over(seg.rowsBetween(-(smooth - 1), 0)), "nth": F.row_number().over(seg), "dollar": F.when(F.count("volume").over(last_20) >= 5, F.avg(F.col("close") * F.col("volume")).over(last_20))})
    peak = F.max(F.struct(F.round("p", 9).alias("r"), (-F.col("nth")).alias("k"), "p", "date")).over(ahead)
    t = t.withColumns({"peak": peak, "last_price": F.last("p").over(seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ok = (F.col("close") >= min_price) & (F.col("dollar") >= min_dollar) & (F.col("p") > 0) & F.col("peak").isNotNull()
    starts = t.filter(ok).withColumn("m", F.col("peak.p") / F.col("p")).filter(F.col("m") >= multiple)
    best = starts.groupBy("ticker").agg(F.max_by(F.struct("segment", "date", "nth", "p", "peak", "m", "last_price"), F.struct(F.round("m", 9).alias("r"), (-F.unix_date("date")).alias("k"))).alias("s")).select("ticker", "s.*")
    # a ticker has one start, so its bars meet one row
    path = t.select("ticker", "segment", F.col("nth").alias("at"), F.col("date").alias("day"), F.col("p").alias("price")).join(best.select("ticker", "segment", "nth", F.col("p").alias("start")), ["ticker", "segment"])
    crossed = path.filter((F.col("at") > F.col("nth")) & (F.col("at") <= F.col("nth") + n) & (F.col("price") >= F.col("start") * multiple)).groupBy("ticker").agg(F.min("day").alias("cross_date"))
    return best.join(crossed, "ticker", "left").select(
        "ticker", F.col("date").alias("start_date"), F.col("p").alias("start_price"), F.col("peak.date").alias("peak_date"), F.col("peak.p").alias("peak_price"), F.col("m").alias("multiple"),
        (-F.col("peak.k") - F.col("nth")).cast("long").alias("days_to_peak"), "cross_date", "last_price", (100 * (F.col("last_price") / F.col("peak.p") - 1)).alias("last_vs_peak_pct"), (F.col("last_price") / F.col("p")).alias("current_multiple"),
    )
