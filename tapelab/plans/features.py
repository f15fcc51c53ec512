"""Window features (WIN) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import features as f
from tapelab.operators.windows import W, frame, full, last_n, r6, trailing_sums
from tapelab.plans import sqltext as s
from tapelab.plans.registry import query

RSI_SQL = lambda n: f"CASE WHEN count(change) OVER {s.over(-(n - 1), 0)} = {n} THEN 100 - 100 / (1 + avg(greatest(change, 0)) OVER {s.over(-(n - 1), 0)} / nullif(avg(greatest(-change, 0)) OVER {s.over(-(n - 1), 0)}, 0)) END"


@query("win1_returns", "bars", sql="SELECT ticker, date, " + ", ".join(f"round(close / lag(close, {n}) OVER ({s.BY}) - 1, 6) AS ret_{n}" for n in (5, 10, 21, 63, 126, 252)) + " FROM bars")
def returns(bars):
    out = f.returns(bars)
    return out.select("ticker", "date", *(r6(c).alias(c) for c in out.columns[2:]))


@query("win2_sma_cross", "bars", sql=f"SELECT ticker, date, round((fast - slow) / slow, 6) AS sma_cross, CASE WHEN close > slow THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS trend FROM (SELECT *, {s.full('avg', 'close', 10)} AS fast, {s.full('avg', 'close', 20)} AS slow FROM bars) AS x")
def sma_cross(bars):
    return bars.select("ticker", "date", r6(f.sma_cross(10, 20)).alias("sma_cross"), f.trend_flag(20).alias("trend"))


@query("win3_volatility", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round(v21, 6) AS vol_21, round(v21 / v63, 6) AS vol_ratio FROM (SELECT *, {s.full('stddev_samp', 'ret_1', 21)} AS v21, {s.full('stddev_samp', 'ret_1', 63)} AS v63 FROM b) AS x")
def volatility(bars):
    v21, v63 = f.volatility("ret_1", 21), f.volatility("ret_1", 63)
    return f.with_basics(bars).select("ticker", "date", r6(v21).alias("vol_21"), r6(F.try_divide(v21, v63)).alias("vol_ratio"))


@query("win4_rsi", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round({RSI_SQL(14)}, 6) AS rsi_14 FROM b")
def rsi(bars):
    return f.with_basics(bars).select("ticker", "date", r6(f.rsi("change", 14)).alias("rsi_14"))


TR = "greatest(high - low, abs(high - prev_close), abs(low - prev_close))"


@query("win5_atr_pct", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round(100 * atr / close, 6) AS atr_pct FROM (SELECT *, {s.full('avg', 'tr', 14)} AS atr FROM (SELECT *, {TR} AS tr FROM b) AS y) AS x")
def atr_pct(bars):
    t = f.with_basics(bars).withColumn("tr", f.true_range())
    return t.select("ticker", "date", r6(100 * full(F.avg, "tr", 14) / F.col("close")).alias("atr_pct"))


@query("win6_volume_z", "bars", sql=f"SELECT ticker, date, round((volume - {s.full('avg', 'volume', 20)}) / nullif({s.full('stddev_samp', 'volume', 20)}, 0), 6) AS volume_z FROM bars")
def volume_z(bars):
    return bars.select("ticker", "date", r6(f.zscore("volume", 20)).alias("volume_z"))


@query(
    "win7_daytrade_features", "bars",
    sql=f"""WITH {s.BASICS}, x AS (SELECT *, ({s.full('avg', 'close', 5)} - {s.full('avg', 'close', 15)}) / {s.full('avg', 'close', 15)} AS cross_, {RSI_SQL(14)} AS rsi, close / {s.lag('close', 5)} - 1 AS roc, (high - low) / close AS day_range FROM b)
        SELECT ticker, date, round({s.lag('cross_')}, 6) AS sma_cross, round({s.lag('rsi')}, 6) AS rsi_14, round({s.lag('roc')}, 6) AS roc_5, round(open / prev_close - 1, 6) AS gap, round({s.lag('day_range')}, 6) AS prev_range FROM x""",
)
def daytrade(bars):
    t = f.with_basics(bars).withColumns({"cross_": f.sma_cross(5, 15), "rsi": f.rsi("change", 14), "roc": F.col("close") / F.lag("close", 5).over(W()) - 1, "day_range": (F.col("high") - F.col("low")) / F.col("close")})
    before = lambda c: r6(F.lag(c).over(W()))
    return t.select("ticker", "date", before("cross_").alias("sma_cross"), before("rsi").alias("rsi_14"), before("roc").alias("roc_5"), r6(F.col("open") / F.col("prev_close") - 1).alias("gap"), before("day_range").alias("prev_range"))


@query("win8_overnight_features", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round(close / open - 1, 6) AS day_return, round(close / vwap - 1, 6) AS close_vs_vwap, round({RSI_SQL(14)}, 6) AS rsi_14, round(close / {s.lag('close', 5)} - 1, 6) AS roc_5 FROM b")
def overnight(bars):
    return f.with_basics(bars).select("ticker", "date", r6(F.col("close") / F.col("open") - 1).alias("day_return"), r6(F.try_divide("close", "vwap") - 1).alias("close_vs_vwap"), r6(f.rsi("change", 14)).alias("rsi_14"), r6(F.col("close") / F.lag("close", 5).over(W()) - 1).alias("roc_5"))


@query(
    "win9_drawdown", "bars",
    sql=f"""SELECT ticker, date, round(1 - close / {s.full('max', 'high', 126)}, 6) AS drawdown_126, round(close / {s.full('min', 'low', 126)} - 1, 6) AS rise_126,
        round(1 - close / CASE WHEN count(high) OVER {s.over(-755, 0)} >= 252 THEN max(high) OVER {s.over(-755, 0)} END, 6) AS drawdown_3y FROM bars""",
)
def drawdown(bars):
    long = F.when(F.count("high").over(last_n(756)) >= 252, F.max("high").over(last_n(756)))
    return bars.select("ticker", "date", r6(f.drawdown(126)).alias("drawdown_126"), r6(f.rise_from_low(126)).alias("rise_126"), r6(1 - F.try_divide("close", long)).alias("drawdown_3y"))


@query("win10_bars_since_high", "bars", sql=f"""WITH {s.BASICS} SELECT ticker, date, CASE WHEN count(high) OVER {s.over(-62, 0)} = 63 THEN nth - (63 - 1) + list_position(list(high) OVER {s.over(-62, 0)}, max(high) OVER {s.over(-62, 0)}) - 1 END AS high_nth FROM b""")
def bars_since_high(bars):
    t = f.with_basics(bars)
    return t.select("ticker", "date", (F.col("nth") - f.bars_since_high(63)).cast("long").alias("high_nth"))


@query("win11_ratios", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round({s.full('avg', 'volume', 21)} / {s.full('avg', 'volume', 252)}, 6) AS volume_21_252, round({s.full('avg', 'span', 21)} / nullif({s.full('avg', 'span', 63)}, 0), 6) AS range_21_63 FROM (SELECT *, high - low AS span FROM b) AS x")
def ratios(bars):
    t = bars.withColumn("span", F.col("high") - F.col("low"))
    return t.select("ticker", "date", r6(f.ratio("volume", 21, 252)).alias("volume_21_252"), r6(f.ratio("span", 21, 63)).alias("range_21_63"))


@query("win12_liquidity_logs", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round(ln(1 + {s.full('avg', 'dollar', 20)}), 6) AS log_dollar, round(ln(greatest(close, 0.01)), 6) AS log_price FROM b")
def liquidity(bars):
    return f.with_basics(bars).select("ticker", "date", r6(F.log1p(full(F.avg, "dollar", 20))).alias("log_dollar"), r6(F.log(F.greatest("close", F.lit(0.01)))).alias("log_price"))


@query("win13_up_ratio", "bars", sql=f"WITH {s.BASICS} SELECT ticker, date, round({s.full('avg', 'up', 21)}, 6) AS up_21, round({s.full('max', 'ret_1', 21)}, 6) AS best_21 FROM (SELECT *, CASE WHEN ret_1 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up FROM b) AS x")
def up_ratio(bars):
    t = f.with_basics(bars).withColumn("up", F.when(F.col("ret_1") > 0, 1.0).otherwise(0.0))
    return t.select("ticker", "date", r6(full(F.avg, "up", 21)).alias("up_21"), r6(full(F.max, "ret_1", 21)).alias("best_21"))


@query("win14_listing_age", "bars", sql=f"SELECT ticker, date, row_number() OVER ({s.BY}) - 1 AS age FROM bars")
def listing_age(bars):
    return bars.select("ticker", "date", (F.row_number().over(W()) - 1).cast("long").alias("age"))


@query(
    "win15_trailing_sentiment", "news",
    sql="""SELECT article_id, ticker, round(avg(sentiment) OVER w, 6) AS mean_24h, count(*) OVER w AS n_24h, own_ticker, round(avg(sentiment) OVER o, 6) AS own_mean_24h, count(*) OVER o AS own_n_24h
        FROM (SELECT article_id, ticker % 10 AS ticker, ticker AS own_ticker, us, sentiment FROM news) AS n
        WINDOW w AS (PARTITION BY ticker ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), o AS (PARTITION BY own_ticker ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
)
def trailing_sentiment(news):
    """Mean and count of articles in (t - 24 h, t]: left open, equal times included. Of the article's own ticker, and of all tickers with its last digit, which is ``ticker``."""
    t = n = news.select("article_id", (F.col("ticker") % 10).alias("ticker"), F.col("ticker").alias("own_ticker"), "us", "sentiment")
    day = 86_400_000_000
    for by, p, stretch in (("own_ticker", "own_", day), ("ticker", "", day // 24)):
        t = trailing_sums(t, by, "us", day, stretch, n, **{f"{p}n_24h": F.lit(1), f"{p}known": F.col("sentiment").isNotNull().cast("int"), f"{p}total": F.coalesce("sentiment", F.lit(0))})
    mean = lambda p: r6(F.try_divide(f"{p}total", f"{p}known")).alias(f"{p}mean_24h")
    return t.select("article_id", "ticker", mean(""), "n_24h", "own_ticker", mean("own_"), "own_n_24h")


@query("win16_smooth", "bars", sql=f"""WITH g AS (SELECT *, sum(jump) OVER {s.over('u', 0)} AS segment FROM (SELECT *, CASE WHEN close / lag(close) OVER ({s.BY}) > 1.1 OR close / lag(close) OVER ({s.BY}) < 1 / 1.1 THEN 1 ELSE 0 END AS jump FROM bars) AS x)
    SELECT ticker, date, CAST(segment AS BIGINT) AS segment, round(quantile_cont(close, 0.5) OVER (PARTITION BY ticker, segment ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM g""")
def smooth(bars):
    return f.smooth(f.segments(bars, 1.1), 5).select("ticker", "date", "segment", r6("smoothed").alias("smoothed"))


@query("win17_segments", "bars", sql=f"SELECT ticker, CAST(segment AS BIGINT) AS segment, count(*) AS bars, min(date) AS first_date FROM (SELECT *, sum(jump) OVER {s.over('u', 0)} AS segment FROM (SELECT *, CASE WHEN close / lag(close) OVER ({s.BY}) > 1.15 OR close / lag(close) OVER ({s.BY}) < 1 / 1.15 THEN 1 ELSE 0 END AS jump FROM bars) AS x) AS y GROUP BY 1, 2")
def segments(bars):
    return f.segments(bars, 1.15).groupBy("ticker", "segment").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first_date"))


@query(
    "win18_price_metrics", "bars",
    sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY ticker) AS n, min(close) OVER (PARTITION BY ticker) AS least FROM bars)
        SELECT ticker, round(max(close) FILTER (back <= 252), 6) AS high_1y, round(max(close) FILTER (back <= 756), 6) AS high_3y, round(max(close) FILTER (back = 1), 6) AS last_close,
               round(100 * (1 - max(close) FILTER (back = 1) / max(close) FILTER (back <= 252)), 4) AS drawdown_pct, round(avg(close * volume) FILTER (back <= 20), 4) AS dollar_20
        FROM r WHERE n >= 260 AND least > 0 GROUP BY ticker""",
)
def price_metrics(bars):
    by = Window.partitionBy("ticker")
    t = bars.withColumns({"back": F.row_number().over(by.orderBy(F.desc("date"))), "n": F.count(F.lit(1)).over(by), "least": F.min("close").over(by)}).filter("n >= 260 and least > 0")
    within = lambda k, c: F.when(F.col("back") <= k, c)
    last = F.max(within(1, F.col("close")))
    high = F.max(within(252, F.col("close")))
    return t.groupBy("ticker").agg(r6(high).alias("high_1y"), r6(F.max(within(756, F.col("close")))).alias("high_3y"), r6(last).alias("last_close"), F.round(100 * (1 - last / high), 4).alias("drawdown_pct"), F.round(F.avg(within(20, F.col("close") * F.col("volume"))), 4).alias("dollar_20"))


@query("win19_market_features", "index_bars", sql=f"SELECT date, round(close / lag(close, 126) OVER ({s.BY}) - 1, 6) AS market_126, round({s.full('stddev_samp', 'r', 63)}, 6) AS market_vol_63 FROM (SELECT *, close / lag(close) OVER ({s.BY}) - 1 AS r FROM index_bars) AS x")
def market(index_bars):
    t = f.with_basics(index_bars.withColumn("volume", F.lit(0.0)))
    return t.select("date", r6(F.col("close") / F.lag("close", 126).over(W()) - 1).alias("market_126"), r6(f.volatility("ret_1", 63)).alias("market_vol_63"))


@query("win20_ttm", "quarters", sql="""SELECT ticker, end_date, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(revenue) OVER w AS BIGINT) END AS ttm_revenue, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(operating_cf - capex) OVER w AS BIGINT) END AS ttm_fcf
    FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def ttm(quarters):
    w = Window.partitionBy("ticker").orderBy("end_date").rowsBetween(-3, 0)
    four = lambda c: F.when(F.count(F.lit(1)).over(w) == 4, F.sum(c).over(w))
    return quarters.select("ticker", "end_date", four(F.col("revenue")).alias("ttm_revenue"), four(F.col("operating_cf") - F.col("capex")).alias("ttm_fcf"))


@query("win21_surprise_delta", "earnings", sql="SELECT ticker, earnings_date, round(surprise_pct - lag(surprise_pct) OVER (PARTITION BY ticker ORDER BY earnings_date, eps_reported), 6) AS surprise_delta FROM earnings")
def surprise_delta(earnings):
    w = Window.partitionBy("ticker").orderBy("earnings_date", "eps_reported")
    return earnings.select("ticker", "earnings_date", r6(F.col("surprise_pct") - F.lag("surprise_pct").over(w)).alias("surprise_delta"))


EVENT_BAR_SQL = "e AS (SELECT e.*, b.nth AS bar_at, coalesce(b.date = e.earnings_date, false) AS exact FROM earnings AS e ASOF LEFT JOIN b ON b.ticker = e.ticker AND b.date >= e.earnings_date), r AS (SELECT *, bar_at + CASE WHEN report_time = 'AMC' AND exact THEN 1 ELSE 0 END AS reaction FROM e)"


@query(
    "win22_event_features", "earnings", "bars",
    sql=f"""WITH {s.BASICS}, {EVENT_BAR_SQL}, x AS (SELECT ticker, nth, open / prev_close - 1 AS gap, ret_1 AS reaction_ret, prev_close / lag(close, 6) OVER ({s.BY}) - 1 AS run_up,
            CASE WHEN count(volume) OVER {s.over(-20, -1)} = 20 THEN coalesce((volume - avg(volume) OVER {s.over(-20, -1)}) / nullif(stddev_samp(volume) OVER {s.over(-20, -1)}, 0), 0) END AS volume_z FROM b)
        SELECT r.ticker, r.earnings_date, r.reaction, round(gap, 6) AS gap, round(reaction_ret, 6) AS reaction_ret, round(run_up, 6) AS run_up, round(volume_z, 6) AS volume_z FROM r JOIN x ON x.ticker = r.ticker AND x.nth = r.reaction WHERE r.reaction > 20""",
)
def event_features(earnings, bars):
    from tapelab.operators.events import event_to_bar

    t = f.with_basics(bars)
    v = F.when(F.count("volume").over(frame(-20, -1)) == 20, F.coalesce(F.try_divide(F.col("volume") - F.avg("volume").over(frame(-20, -1)), F.stddev_samp("volume").over(frame(-20, -1))), F.lit(0.0)))
    x = t.select("ticker", "nth", (F.col("open") / F.col("prev_close") - 1).alias("gap"), F.col("ret_1").alias("reaction_ret"), (F.col("prev_close") / F.lag("close", 6).over(W()) - 1).alias("run_up"), v.alias("volume_z"))
    e = event_to_bar(earnings, t.select("ticker", "date", "nth"))
    j = e.join(x, (x["ticker"] == e["ticker"]) & (x["nth"] == e["reaction"])).filter("reaction > 20")
    return j.select(e["ticker"], "earnings_date", F.col("reaction").cast("long"), *(r6(c).alias(c) for c in ("gap", "reaction_ret", "run_up", "volume_z")))


@query(
    "win23_event_buildup", "earnings", "bars",
    sql=f"""WITH {s.BASICS}, {EVENT_BAR_SQL}, x AS (SELECT ticker, nth, avg(volume) OVER {s.over(-5, -1)} / avg(volume) OVER {s.over(-25, -6)} AS build_up, prev_close / lag(close, 11) OVER ({s.BY}) - 1 AS run_up_10 FROM b)
        SELECT r.ticker, r.earnings_date, r.reaction, round(build_up, 6) AS build_up, round(run_up_10, 6) AS run_up_10 FROM r JOIN x ON x.ticker = r.ticker AND x.nth = r.reaction WHERE r.reaction > 25""",
)
def event_buildup(earnings, bars):
    from tapelab.operators.events import event_to_bar

    t = f.with_basics(bars)
    x = t.select("ticker", "nth", F.try_divide(F.avg("volume").over(frame(-5, -1)), F.avg("volume").over(frame(-25, -6))).alias("build_up"), (F.col("prev_close") / F.lag("close", 11).over(W()) - 1).alias("run_up_10"))
    e = event_to_bar(earnings, t.select("ticker", "date", "nth"))
    j = e.join(x, (x["ticker"] == e["ticker"]) & (x["nth"] == e["reaction"])).filter("reaction > 25")
    return j.select(e["ticker"], "earnings_date", F.col("reaction").cast("long"), r6("build_up").alias("build_up"), r6("run_up_10").alias("run_up_10"))


@query(
    "win24_event_micro", "earnings", "bars",
    sql=f"""WITH {s.BASICS}, {EVENT_BAR_SQL}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT ticker, nth, abs(ret_1) / (dollar / 1000000) AS amihud,
            (close - avg(close) OVER {s.over(-20, -1)}) / nullif(2 * stddev_pop(close) OVER {s.over(-20, -1)}, 0) AS bollinger, tr / nullif(avg(tr) OVER {s.over(-14, -1)}, 0) AS atr_ratio FROM t)
        SELECT r.ticker, r.earnings_date, r.reaction, round(amihud, 5) AS amihud, round(bollinger, 6) AS bollinger, round(atr_ratio, 6) AS atr_ratio, round(sign(surprise_pct) * ln(1 + abs(surprise_pct)), 6) AS signed_surprise
        FROM r JOIN x ON x.ticker = r.ticker AND x.nth = r.reaction WHERE r.reaction > 21""",
)
def event_micro(earnings, bars):
    from tapelab.operators.events import event_to_bar

    t = f.with_basics(bars).withColumn("tr", f.true_range())
    x = t.select(
        "ticker", "nth", F.try_divide(F.abs("ret_1"), F.col("dollar") / 1_000_000).alias("amihud"), F.try_divide(F.col("close") - F.avg("close").over(frame(-20, -1)), 2 * F.stddev_pop("close").over(frame(-20, -1))).alias("bollinger"),
        F.try_divide("tr", F.avg("tr").over(frame(-14, -1))).alias("atr_ratio"),
    )
    e = event_to_bar(earnings, t.select("ticker", "date", "nth"))
    j = e.join(x, (x["ticker"] == e["ticker"]) & (x["nth"] == e["reaction"])).filter("reaction > 21")
    return j.select(e["ticker"], "earnings_date", F.col("reaction").cast("long"), F.round("amihud", 5).alias("amihud"), r6("bollinger").alias("bollinger"), r6("atr_ratio").alias("atr_ratio"), r6(F.signum("surprise_pct") * F.log1p(F.abs("surprise_pct"))).alias("signed_surprise"))


QL = "extract(YEAR FROM end_date) * 4 + extract(QUARTER FROM end_date)"


def _ordinals(quarters):
    o = (F.year("end_date") * 4 + F.quarter("end_date")).cast("long")
    t = quarters.withColumn("o", o).filter((F.col("ticker") + F.col("o")) % 6 != 0)
    return t.withColumn("p", F.lag("o").over(Window.partitionBy("ticker").orderBy("o")))


@query("win27_delta_score", "scored", sql="SELECT ticker, date, round(score - lag(score) OVER (PARTITION BY ticker ORDER BY date), 6) AS delta_score FROM scored")
def delta_score(scored):
    return scored.select("ticker", "date", r6(F.col("score") - F.lag("score").over(W())).alias("delta_score"))
