"""Forward outcomes and labels (LBL) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import outcomes as o
from tapelab.operators.windows import W, frame, r6
from tapelab.plans import sqltext as s
from tapelab.plans.features import EVENT_BAR_SQL
from tapelab.plans.registry import query

NTH = f"b AS (SELECT *, row_number() OVER ({s.BY}) AS nth FROM bars)"


@query(
    "lbl1_fwd_return_time", "ticks",
    sql="""SELECT event_id, ticker, round(later / price - 1, 6) AS fwd, CASE WHEN later > price THEN 1 ELSE 0 END AS label FROM (
        SELECT event_id, ticker, price, first_value(price) OVER (PARTITION BY ticker ORDER BY us RANGE BETWEEN 86400000000 FOLLOWING AND 259200000000 FOLLOWING) AS later FROM ticks) AS x WHERE later IS NOT NULL""",
)
def fwd_time(ticks):
    t = o.forward_by_time(ticks, 86_400_000_000, 172_800_000_000)
    return t.filter("later is not null").select("event_id", "ticker", r6(F.col("later") / F.col("price") - 1).alias("fwd"), (F.col("later") > F.col("price")).cast("int").alias("label"))


@query("lbl2_fwd_return_bars", "bars", sql=f"SELECT ticker, date, round(lead(close, 10) OVER ({s.BY}) / close - 1, 6) AS fwd_10, CASE WHEN lead(close, 10) OVER ({s.BY}) / close - 1 >= 0.03 THEN 1 ELSE 0 END AS label FROM bars")
def fwd_bars(bars):
    fwd = F.lead("close", 10).over(W()) / F.col("close") - 1
    return bars.select("ticker", "date", r6(fwd).alias("fwd_10"), F.when(fwd >= 0.03, 1).otherwise(0).alias("label"))


@query("lbl3_day_and_night", "bars", sql=f"SELECT ticker, date, round(close / open - 1, 6) AS intraday, round(lead(open) OVER ({s.BY}) / close - 1, 6) AS overnight FROM bars")
def day_night(bars):
    return bars.select("ticker", "date", r6(F.col("close") / F.col("open") - 1).alias("intraday"), r6(F.lead("open").over(W()) / F.col("close") - 1).alias("overnight"))


@query("lbl4_event_fwd", "earnings", "bars", sql=f"WITH {NTH}, t AS (SELECT ticker, nth, close, lead(close, 8) OVER ({s.BY}) AS later FROM b), {EVENT_BAR_SQL} SELECT r.ticker, r.earnings_date, round(t.later / t.close - 1, 6) AS fwd_8 FROM r JOIN t ON t.ticker = r.ticker AND t.nth = r.reaction WHERE t.later IS NOT NULL")
def event_fwd(earnings, bars):
    from tapelab.operators.events import event_to_bar

    t = bars.withColumns({"nth": F.row_number().over(W()), "later": F.lead("close", 8).over(W())})
    e = event_to_bar(earnings, t.select("ticker", "date", "nth"))
    return e.join(t.select(F.col("ticker").alias("tk"), "nth", "close", "later"), (F.col("tk") == e["ticker"]) & (F.col("nth") == e["reaction"])).filter("later is not null").select("ticker", "earnings_date", r6(F.col("later") / F.col("close") - 1).alias("fwd_8"))


@query("lbl5_fwd_max_multiple", "bars", sql=f"SELECT ticker, date, CASE WHEN count(*) OVER {s.over(1, 63)} >= 62 THEN round(max(high) OVER {s.over(1, 63)} / close, 6) END AS fwd_max FROM bars")
def fwd_max(bars):
    return bars.select("ticker", "date", r6(o.forward_max_multiple(63)).alias("fwd_max"))


@query("lbl6_fwd_truncated", "bars", sql=f"SELECT ticker, date, round(max(high) OVER w / close, 6) AS fwd_max, count(*) OVER w AS bars_ahead, round(last_value(close) OVER w / close - 1, 6) AS fwd_ret FROM bars WINDOW w AS {s.over(1, 63)}")
def fwd_truncated(bars):
    w = frame(1, 63)
    return bars.select("ticker", "date", r6(F.max("high").over(w) / F.col("close")).alias("fwd_max"), F.count("high").over(w).alias("bars_ahead"), r6(F.last("close").over(w) / F.col("close") - 1).alias("fwd_ret"))


CUT = "cut AS (SELECT * FROM bars WHERE NOT (ticker % 8 = 7 AND date > DATE '1998-06-30'))"


@query("lbl7_delisted", "bars", sql=f"WITH {CUT} SELECT ticker, max(date) AS last_date, max(date) < (SELECT max(date) FROM cut) - 14 AS delisted FROM cut GROUP BY ticker")
def delisted(bars):
    return o.delisted(o.cut_archive(bars), 14)


#: Bars ahead at which an event's return is taken.
HORIZONS = (1, 5, 21, 63, 126, 252)


@query(
    "lbl8_event_returns", "earnings", "bars",
    sql=f"WITH {NTH}, t AS (SELECT ticker, nth + 1 AS at_bar, close, [{', '.join(f'lead(close, {h}) OVER ({s.BY})' for h in HORIZONS)}] AS ahead FROM b), {EVENT_BAR_SQL}, j AS (SELECT r.ticker, r.earnings_date, t.close, unnest([{', '.join(map(str, HORIZONS))}]) AS horizon, unnest(t.ahead) AS later FROM r JOIN t ON t.ticker = r.ticker AND t.at_bar = r.reaction) SELECT ticker, earnings_date, CAST(horizon AS INTEGER) AS horizon, round(later / close - 1, 6) AS ret FROM j WHERE later IS NOT NULL",
)
def event_returns(earnings, bars):
    """Returns from the close before the reaction bar to the close of bar reaction + h - 1."""
    from tapelab.operators.events import event_to_bar

    t = bars.withColumn("nth", F.row_number().over(W()))
    path = t.select(F.col("ticker").alias("tk"), (F.col("nth") + 1).alias("at_bar"), "close", F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(W()).alias("later")) for h in HORIZONS)).alias("ahead"))
    e = event_to_bar(earnings, t.select("ticker", "date", "nth")).join(path, (F.col("tk") == F.col("ticker")) & (F.col("at_bar") == F.col("reaction")))
    return e.select("ticker", "earnings_date", "close", F.inline("ahead")).filter("later is not null").select("ticker", "earnings_date", "horizon", r6(F.col("later") / F.col("close") - 1).alias("ret"))


@query("lbl9_quarter_label", "earnings", sql="SELECT ticker, earnings_date, CAST(extract(YEAR FROM earnings_date - INTERVAL 45 DAY) AS VARCHAR) || 'Q' || CAST(extract(QUARTER FROM earnings_date - INTERVAL 45 DAY) AS VARCHAR) AS quarter FROM earnings")
def quarter_label(earnings):
    d = F.date_sub("earnings_date", 45)
    return earnings.select("ticker", "earnings_date", F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"))


def _announced_sql(base: int, later: int) -> str:
    """Returns over bars after the last one before the filing: from the ``base``-th to the ``later``-th."""
    start = f"lead(close, {base}) OVER ({s.BY})" if base else "close"
    return f"WITH t AS (SELECT ticker, date, {start} AS base, lead(close, {later}) OVER ({s.BY}) AS later FROM bars) SELECT f.ticker, f.filing_date, round(t.later / t.base - 1, 6) AS ret_21 FROM filings AS f ASOF JOIN t ON t.ticker = f.ticker AND t.date < f.filing_date WHERE t.later IS NOT NULL"


def _announced(filings, bars, base: int, later: int):
    from tapelab.operators.asof import asof_join

    t = bars.select("ticker", "date", (F.lead("close", base).over(W()) if base else F.col("close")).alias("base"), F.lead("close", later).over(W()).alias("later"))
    j = asof_join(filings, t, "ticker", "filing_date", "date", inclusive=False).filter("match.later is not null")
    return j.select("ticker", "filing_date", r6(F.col("match.later") / F.col("match.base") - 1).alias("ret_21"))


@query("lbl10_announce_return", "filings", "bars", sql=_announced_sql(0, 21))
def announce_return(filings, bars):
    """From the last close before the filing: the jump of the day is in it."""
    return _announced(filings, bars, 0, 21)


@query("lbl10_announce_post", "filings", "bars", sql=_announced_sql(2, 22))
def announce_post(filings, bars):
    """From the close of the bar after the filing's: what could still be bought."""
    return _announced(filings, bars, 2, 22)


@query("lbl12_excess", "panel", "index_bars", sql=f"WITH i AS (SELECT date, lead(close, 63) OVER ({s.BY}) / close - 1 AS bench FROM index_bars) SELECT p.ticker, p.date, round(fwd_ret - bench, 6) AS excess, round(100 * ((1 + fwd_ret) / (1 + bench) - 1), 6) AS relative_pct FROM panel AS p JOIN i ON i.date = p.date WHERE fwd_ret IS NOT NULL AND bench IS NOT NULL")
def excess(panel, index_bars):
    i = index_bars.select("date", (F.lead("close", 63).over(W()) / F.col("close") - 1).alias("bench"))
    return o.excess(panel.filter("fwd_ret is not null"), i.filter("bench is not null"), "fwd_ret", "bench").select("ticker", "date", r6("excess").alias("excess"), r6("relative_pct").alias("relative_pct"))


@query("lbl14_best_run", "bars", sql=f"""WITH r AS (SELECT ticker, date AS start_date, max(close) OVER {s.over(1, 126)} / close AS multiple, close FROM bars WHERE close >= 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(multiple, 9) DESC, start_date) AS nth FROM r WHERE multiple IS NOT NULL),
    p AS (SELECT k.ticker, k.start_date, k.multiple, b.date, row_number() OVER (PARTITION BY k.ticker ORDER BY b.date) AS j, b.close / k.close AS m FROM k JOIN bars AS b ON b.ticker = k.ticker AND b.date > k.start_date WHERE k.nth = 1)
    SELECT ticker, start_date, round(multiple, 6) AS multiple, min(date) FILTER (round(m, 9) = round(multiple, 9) AND j <= 126) AS peak_date, min(date) FILTER (m >= 1.2 AND j <= 126) AS cross_date FROM p GROUP BY ticker, start_date, multiple""")
def best_run(bars):
    return o.best_run(bars, 126, 1.2, 1.0).select("ticker", "start_date", r6("multiple").alias("multiple"), "peak_date", "cross_date")


@query("lbl15_coarse_screen", "bars", sql="""WITH q AS (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS quarter, max(high) AS high, max_by(close, date) AS close FROM bars GROUP BY 1, 2),
    m AS (SELECT ticker, quarter, max(high) OVER (PARTITION BY ticker ORDER BY quarter ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) / close AS multiple FROM q WHERE close >= 1)
    SELECT ticker, quarter, round(multiple, 6) AS multiple FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(multiple, 9) DESC, quarter) AS nth FROM m WHERE multiple >= 1.2) AS x WHERE nth = 1""")
def coarse(bars):
    q = bars.groupBy("ticker", F.to_date(F.date_trunc("quarter", "date")).alias("quarter")).agg(F.max("high").alias("high"), F.max_by("close", "date").alias("close")).filter("close >= 1")
    w = Window.partitionBy("ticker").orderBy("quarter")
    m = q.withColumn("multiple", F.max("high").over(w.rowsBetween(1, 4)) / F.col("close")).filter("multiple >= 1.2")
    return m.withColumn("nth", F.row_number().over(Window.partitionBy("ticker").orderBy(F.round("multiple", 9).desc(), "quarter"))).filter("nth = 1").select("ticker", "quarter", r6("multiple").alias("multiple"))


@query("lbl18_net_return", "scored", sql="SELECT ticker, date, slip, round(fwd_ret - 2 * slip - 2 * 0.0001::DOUBLE, 6) AS net FROM scored CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.005::DOUBLE, 0.02::DOUBLE]) AS slip) AS v")
def net_return(scored):
    return scored.select("ticker", "date", "fwd_ret", F.explode(F.array(F.lit(0.0), F.lit(0.005), F.lit(0.02))).alias("slip")).select("ticker", "date", "slip", r6(F.col("fwd_ret") - 2 * F.col("slip") - 2 * F.lit(0.0001)).alias("net"))


@query(
    "lbl19_spaced_points_time", "ticks",
    sql="""WITH RECURSIVE k AS (SELECT ticker, min(us) AS us FROM ticks GROUP BY ticker UNION ALL SELECT k.ticker, (SELECT min(t.us) FROM ticks AS t WHERE t.ticker = k.ticker AND t.us >= k.us + 86400000000) FROM k WHERE k.us IS NOT NULL)
        SELECT ticker, us FROM k WHERE us IS NOT NULL""",
)
def spaced_time(ticks):
    return o.spaced_by_time(ticks, 86_400_000_000)


@query("lbl20_spaced_points_rows", "bars", sql=f"SELECT ticker, date FROM (SELECT *, row_number() OVER ({s.BY}) AS nth FROM bars) AS x WHERE (nth - 1) % 10 = 0")
def spaced_rows(bars):
    return bars.withColumn("nth", F.row_number().over(W())).filter("(nth - 1) % 10 = 0").select("ticker", "date")
