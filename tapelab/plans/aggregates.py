"""Aggregations (AGG) and scans (SRC) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators.stats import quantiles
from tapelab.operators.windows import W, r6
from tapelab.plans import sqltext as s
from tapelab.plans.whole import BARRIER_SQL, barrier
from tapelab.plans.registry import query
from tapelab.sources.files import stored


def ohlcv(ticks, day):
    """Bars of any span: ordered by time, with the volume-weighted price."""
    at = F.struct("us", "event_id")
    return ticks.groupBy("ticker", day.alias("date")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("transactions"), F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap")
    )


@query("agg1_resample", "ticks", sql="SELECT ticker, CAST(ts AS DATE) AS date, round(min_by(price, (us, event_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(max_by(price, (us, event_id)), 6) AS close, round(sum(volume), 4) AS volume, count(*) AS transactions, round(sum(price * volume) / sum(volume), 5) AS vwap FROM ticks GROUP BY 1, 2")
def resample(ticks):
    t = ohlcv(ticks, F.to_date("ts"))
    return t.select("ticker", "date", *(r6(c).alias(c) for c in ("open", "high", "low", "close")), F.round("volume", 4).alias("volume"), "transactions", F.round("vwap", 5).alias("vwap"))


@query("agg2_weekly_series", "bars", sql="SELECT ticker, CAST(date + (5 - isodow(date) + 7) % 7 AS DATE) AS week, round(max_by(close, date), 6) AS close FROM bars GROUP BY 1, 2".replace("isodow(date)", "CAST(isodow(date) AS INTEGER)"))
def weekly(bars):
    return bars.groupBy("ticker", F.next_day(F.date_sub("date", 1), "FRI").alias("week")).agg(r6(F.max_by("close", "date")).alias("close"))


@query("agg3_typical_price", "bars", sql="SELECT ticker, date, round((high + low + close) / 3, 6) AS typical, CAST(1 AS INTEGER) AS trades FROM bars")
def typical(bars):
    return bars.select("ticker", "date", r6((F.col("high") + F.col("low") + F.col("close")) / 3).alias("typical"), F.lit(1).alias("trades"))


@query("agg4_article_sentiment", "news", sql="SELECT ticker, CAST(published AS DATE) AS day, round(avg(sentiment), 6) AS mean_sentiment, count(*) AS n FROM news GROUP BY 1, 2")
def article_sentiment(news):
    return news.groupBy("ticker", F.to_date("published").alias("day")).agg(r6(F.avg("sentiment")).alias("mean_sentiment"), F.count(F.lit(1)).alias("n"))


@query("agg5_news_summary", "news", sql="SELECT ticker, date_trunc('month', published)::DATE AS month, count(*) AS n, round(avg(sentiment), 6) AS mean_sentiment, round(avg(CASE WHEN sentiment < 0 THEN 1 ELSE 0 END), 6) AS negative_share, round(avg(CASE WHEN sentiment > 0 THEN 1 ELSE 0 END), 6) AS upside_rate, bool_or(sentiment < 0) AS any_distress FROM news GROUP BY 1, 2")
def news_summary(news):
    share = lambda c: r6(F.avg(c.cast("int")))
    return news.groupBy("ticker", F.to_date(F.date_trunc("month", F.col("published").cast("timestamp"))).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("sentiment")).alias("mean_sentiment"), share(F.col("sentiment") < 0).alias("negative_share"), share(F.col("sentiment") > 0).alias("upside_rate"), F.bool_or(F.col("sentiment") < 0).alias("any_distress")
    )


@query("agg6_coverage_by_group", "scored", "news", sql="WITH n AS (SELECT ticker, count(*) AS articles FROM news GROUP BY ticker), x AS (SELECT label, n.articles FROM scored AS s LEFT JOIN n ON n.ticker = s.ticker) SELECT label, round(avg(CASE WHEN articles IS NULL THEN 0 ELSE 1 END), 6) AS with_news, median(articles)::DOUBLE AS median_articles FROM x GROUP BY label")
def coverage(scored, news):
    x = scored.join(news.groupBy("ticker").agg(F.count(F.lit(1)).alias("articles")), "ticker", "left")
    g = x.groupBy("label").agg(r6(F.avg(F.col("articles").isNotNull().cast("int"))).alias("with_news"))
    return g.join(quantiles(x, "articles", ["label"], median_articles=0.5), "label", "left")


@query("agg7_base_rates", "panel", sql="SELECT threshold, round(avg(CASE WHEN fwd_multiple >= threshold THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n FROM panel CROSS JOIN (SELECT unnest([1.1::DOUBLE, 1.25::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS threshold) AS t WHERE fwd_multiple IS NOT NULL GROUP BY threshold")
def base_rates(panel):
    x = panel.filter("fwd_multiple is not null").select("fwd_multiple", F.explode(F.array(*map(F.lit, (1.1, 1.25, 1.5, 2.0)))).alias("threshold"))
    return x.groupBy("threshold").agg(r6(F.avg((F.col("fwd_multiple") >= F.col("threshold")).cast("int"))).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("agg8_trade_stats", "bars", sql=f"SELECT outcome, count(*) AS n, round(avg(ret), 5) AS mean_ret, round(median(ret), 5) AS median_ret, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(held), 6) AS mean_hold FROM ({BARRIER_SQL}) AS t GROUP BY outcome")
def trade_stats(bars):
    t = stored(barrier(bars).select("outcome", "ret", "held"), "trades")  # read for the means, the cuts and the counts of ranges
    g = t.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 5).alias("mean_ret"), r6(F.avg((F.col("ret") > 0).cast("int"))).alias("win_rate"), r6(F.avg("held")).alias("mean_hold"))
    return g.join(quantiles(t, "ret", ["outcome"], median_ret=0.5), "outcome", "left").withColumn("median_ret", F.round("median_ret", 5))


@query("agg9_pooled_stats", "scored", sql="SELECT year, count(*) AS n, round(avg(fwd_ret), 6) AS mean_ret, round(stddev_pop(fwd_ret), 6) AS std_ret, round(avg(fwd_ret) / nullif(stddev_pop(fwd_ret), 0), 5) AS mean_over_std FROM scored GROUP BY year")
def pooled(scored):
    sd = F.stddev_pop("fwd_ret")
    return scored.groupBy("year").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd_ret")).alias("mean_ret"), r6(sd).alias("std_ret"), F.round(F.try_divide(F.avg("fwd_ret"), sd), 5).alias("mean_over_std"))


@query("agg11_buy_hold", "bars", sql="WITH t AS (SELECT ticker, max_by(close, date) / min_by(close, date) - 1 AS r FROM bars WHERE date >= DATE '1995-01-01' AND date < DATE '1997-01-01' GROUP BY ticker HAVING count(*) >= 2) SELECT count(*) AS tickers, round(coalesce(avg(r), 0), 6) AS buy_hold FROM t")
def buy_hold(bars):
    t = bars.filter((F.col("date") >= F.lit("1995-01-01").cast("date")) & (F.col("date") < F.lit("1997-01-01").cast("date"))).groupBy("ticker").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return t.agg(F.count(F.lit(1)).alias("tickers"), r6(F.coalesce(F.avg("r"), F.lit(0.0))).alias("buy_hold"))


@query("agg12_full_benchmark", "bars", sql="SELECT ticker, min(date) AS first_date, max(date) AS last_date, round(max_by(close, date) / min_by(close, date) - 1, 6) AS ret FROM bars GROUP BY ticker")
def full_benchmark(bars):
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), r6(F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("ret"))


@query("agg13_ttm_snapshot", "quarters", sql="WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS k FROM quarters), a AS (SELECT ticker, max(end_date) AS end_date, sum(revenue) FILTER (k <= 4) AS now_, sum(revenue) FILTER (k BETWEEN 5 AND 8) AS before_, sum(net_income) FILTER (k <= 4) AS ni, sum(operating_cf - capex) FILTER (k <= 4) AS fcf FROM r WHERE k <= 8 GROUP BY ticker HAVING count(*) = 8) SELECT ticker, end_date, CAST(now_ AS BIGINT) AS ttm_revenue, round(100.0 * (now_ - before_) / before_, 4) AS growth_pct, round(100.0 * ni / now_, 4) AS net_margin_pct, round(100.0 * fcf / now_, 4) AS fcf_margin_pct FROM a WHERE now_ > 0 AND before_ > 0")
def ttm_snapshot(quarters):
    t = quarters.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("end_date")))).filter("k <= 8")
    some = lambda c, a, b: F.sum(F.when(F.col("k").between(a, b), c))
    a = t.groupBy("ticker").agg(F.max("end_date").alias("end_date"), some(F.col("revenue"), 1, 4).alias("now_"), some(F.col("revenue"), 5, 8).alias("before_"), some(F.col("net_income"), 1, 4).alias("ni"), some(F.col("operating_cf") - F.col("capex"), 1, 4).alias("fcf"), F.count(F.lit(1)).alias("n"))
    pct = lambda x, y: F.round(F.lit(100.0) * x / y, 4)
    return a.filter("n = 8 and now_ > 0 and before_ > 0").select("ticker", "end_date", F.col("now_").alias("ttm_revenue"), pct(F.col("now_") - F.col("before_"), F.col("before_")).alias("growth_pct"), pct(F.col("ni"), F.col("now_")).alias("net_margin_pct"), pct(F.col("fcf"), F.col("now_")).alias("fcf_margin_pct"))


@query("agg14_lifetime_totals", "quarters", sql="SELECT ticker, CAST(sum(greatest(revenue, 0)) AS BIGINT) AS revenue, CAST(-sum(least(net_income, 0)) AS BIGINT) AS losses, round(sum(greatest(revenue, 0))::DOUBLE / nullif(-sum(least(net_income, 0)), 0)::DOUBLE, 6) AS offset_ratio FROM quarters GROUP BY ticker")
def lifetime(quarters):
    rev, loss = F.sum(F.greatest(F.col("revenue"), F.lit(0))), -F.sum(F.least(F.col("net_income"), F.lit(0)))
    return quarters.groupBy("ticker").agg(rev.alias("revenue"), loss.alias("losses"), r6(F.try_divide(rev.cast("double"), loss.cast("double"))).alias("offset_ratio"))


@query("agg16_panel_profile", "panel", sql="SELECT count(DISTINCT ticker) AS tickers, count(*) AS n, count(*) FILTER (fwd_ret IS NULL) AS truncated, round(avg(CASE WHEN drawdown IS NULL THEN 1 ELSE 0 END), 6) AS no_history FROM panel")
def profile(panel):
    return panel.agg(F.countDistinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("fwd_ret").isNull()).alias("truncated"), r6(F.avg(F.col("drawdown").isNull().cast("int"))).alias("no_history"))


TIER = "CASE WHEN score >= 0.1 THEN 'T2' WHEN score >= 0.05 THEN 'T1' ELSE 'T0' END"


@query("agg17_tier_table", "scored", sql=f"SELECT {TIER} AS tier, count(*) AS n, round(median(fwd_ret), 6) AS median_ret FROM scored GROUP BY 1")
def tier_table(scored):
    tier = F.when(F.col("score") >= 0.1, "T2").when(F.col("score") >= 0.05, "T1").otherwise("T0")
    x = scored.select(tier.alias("tier"), "fwd_ret")
    return x.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).join(quantiles(x, "fwd_ret", ["tier"], median_ret=0.5), "tier", "left").withColumn("median_ret", r6("median_ret"))


@query("agg19_hit_summary", "scored", sql="WITH h AS (SELECT fwd_multiple, fwd_ret, row_number() OVER (ORDER BY fwd_multiple) - 1 AS i, count(*) OVER () AS n FROM scored WHERE label = 1) SELECT count(*) AS hits, round(max(fwd_multiple) FILTER (i = n // 2), 6) AS upper_median, count(*) FILTER (1 + fwd_ret >= 1.3) AS still_above, count(*) FILTER (fwd_ret < 0) AS below_start FROM h")
def hit_summary(scored):
    """The median is the upper of the two middle values."""
    h = scored.filter("label = 1")
    n = F.count(F.lit(1))
    total = h.agg(n.alias("hits"), F.count_if(1 + F.col("fwd_ret") >= 1.3).alias("still_above"), F.count_if(F.col("fwd_ret") < 0).alias("below_start"))
    upper = quantiles(h, "fwd_multiple", [], upper=True, median=0.5).select(r6("median").alias("upper_median"))
    return total.join(F.broadcast(upper)).select("hits", "upper_median", "still_above", "below_start")  # one row each


@query("agg20_matched_sample", "scored", sql="WITH x AS (SELECT *, row_number() OVER (PARTITION BY fwd_ret < 0 ORDER BY (nth * 7919 + ticker * 104729) % 1009, ticker, date) AS r, count(*) FILTER (fwd_ret < 0) OVER () AS losers FROM scored) SELECT fwd_ret < 0 AS loser, count(*) AS n, CAST(sum(ticker) AS BIGINT) AS ticker_sum FROM x WHERE fwd_ret < 0 OR r <= losers GROUP BY 1")
def matched(scored):
    """All losers and as many winners, by a stable order of their keys."""
    from tapelab.operators.stats import first_rows

    losers = scored.filter("fwd_ret < 0")
    n = losers.agg(F.count(F.lit(1)).alias("losers"))
    winners = first_rows(scored.filter("fwd_ret >= 0"), (F.col("nth") * 7919 + F.col("ticker") * 104729) % 1009, [F.col("ticker"), F.col("date")], n)
    return losers.unionByName(winners).groupBy((F.col("fwd_ret") < 0).alias("loser")).agg(F.count(F.lit(1)).alias("n"), F.sum("ticker").alias("ticker_sum"))
