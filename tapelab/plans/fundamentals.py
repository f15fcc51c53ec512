"""Fundamentals, valuations and stages (LED, WIN28-30) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import facts as f
from tapelab.operators.windows import r6
from tapelab.plans.registry import query

QW = "PARTITION BY ticker ORDER BY end_date"
STAGE = "CASE WHEN revenue <= 0 OR revenue IS NULL THEN 0 WHEN net_income <= 0 OR net_income IS NULL THEN 1 WHEN operating_cf - capex <= 0 OR operating_cf IS NULL THEN 2 ELSE 3 END"

DISCRETE = """e AS (SELECT ticker, start_date, end_date, val, row_number() OVER (PARTITION BY ticker, start_date, end_date ORDER BY filed) AS k FROM facts WHERE concept = 'Revenue'),
    q AS (SELECT ticker, end_date, val FROM e WHERE k = 1 AND end_date - start_date BETWEEN 80 AND 100),
    y AS (SELECT ticker, start_date, end_date, val FROM e WHERE k = 1 AND end_date - start_date BETWEEN 350 AND 380),
    q4 AS (SELECT y.ticker, y.end_date, CAST(max(y.val) - sum(q.val) AS BIGINT) AS val FROM y JOIN q ON q.ticker = y.ticker AND q.end_date > y.start_date AND q.end_date < y.end_date GROUP BY y.ticker, y.end_date HAVING count(*) = 3),
    d AS (SELECT * FROM q UNION ALL SELECT * FROM q4 WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.ticker = q4.ticker AND q.end_date = q4.end_date))"""


@query("led1_quarterly", "facts", sql=f"WITH {DISCRETE} SELECT ticker, end_date, val FROM d")
def quarterly(facts):
    return f.discrete_quarters(facts.filter("concept = 'Revenue'"))


@query("led2_quarterize_cumulative", "facts", sql="SELECT ticker, end_date, CAST(val - coalesce(lag(val) OVER (PARTITION BY ticker, start_date ORDER BY end_date), 0) AS BIGINT) AS val FROM (SELECT *, row_number() OVER (PARTITION BY ticker, start_date, end_date ORDER BY filed) AS k FROM facts WHERE concept = 'OperatingCF') AS x WHERE k = 1")
def cumulative(facts):
    return f.difference_cumulative(facts.filter("concept = 'OperatingCF'"))


@query("led3_free_cash_flow", "quarters", sql="SELECT ticker, end_date, operating_cf - coalesce(CASE WHEN capex % 5 <> 0 THEN capex END, 0) AS fcf FROM quarters")
def fcf(quarters):
    return quarters.select("ticker", "end_date", (F.col("operating_cf") - F.coalesce(F.when(F.col("capex") % 5 != 0, F.col("capex")), F.lit(0))).alias("fcf"))


@query("led4_fundamentals", "facts", "filings", sql=f"WITH {DISCRETE}, m AS (SELECT d.ticker, d.end_date, d.val, min(x.filing_date) AS filing FROM d LEFT JOIN filings AS x ON x.ticker = d.ticker AND x.filing_date > d.end_date AND x.filing_date <= d.end_date + 100 GROUP BY 1, 2, 3) SELECT m.ticker, m.end_date, m.val AS revenue, CASE WHEN filing <= m.end_date + 40 THEN filing ELSE m.end_date + 40 END AS announced, round(100.0 * (m.val - p.val) / p.val, 4) AS yoy_pct FROM m LEFT JOIN d AS p ON p.ticker = m.ticker AND p.end_date = (SELECT min(c.end_date) FROM d AS c WHERE c.ticker = m.ticker AND c.end_date BETWEEN m.end_date - 380 AND m.end_date - 350)")
def fundamentals(facts, filings):
    from tapelab.plans.joins import announce

    d = f.discrete_quarters(facts.filter("concept = 'Revenue'"))
    w = Window.partitionBy("ticker").orderBy(F.unix_date("end_date")).rangeBetween(-380, -350)
    y = d.withColumn("before", F.first("val").over(w))
    a = announce(y, filings).drop("source")
    return y.join(a, ["ticker", "end_date"]).select("ticker", "end_date", F.col("val").alias("revenue"), "announced", F.round(F.try_divide(F.lit(100.0) * (F.col("val") - F.col("before")), F.col("before")), 4).alias("yoy_pct"))


@query("led5_merge_financials", "quarters", sql="SELECT a.ticker, a.end_date, a.revenue, b.operating_cf - b.capex AS fcf FROM quarters AS a LEFT JOIN quarters AS b ON b.ticker = a.ticker AND b.end_date = a.end_date AND b.operating_cf > 0")
def merge_financials(quarters):
    cash = quarters.filter("operating_cf > 0").select("ticker", "end_date", (F.col("operating_cf") - F.col("capex")).alias("fcf"))
    return quarters.select("ticker", "end_date", "revenue").join(cash, ["ticker", "end_date"], "left")


VALUATION = """t AS (SELECT ticker, end_date, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(revenue) OVER w AS DOUBLE) END AS ttm FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    v AS (SELECT t.ticker, t.end_date, (SELECT max_by(b.close, b.date) FROM bars AS b WHERE b.ticker = t.ticker AND b.date < t.end_date) * coalesce((SELECT product(ratio) FROM splits AS s WHERE s.ticker = t.ticker AND s.split_date > t.end_date), 1) * 1000000 / ttm AS ps FROM t)"""


@query("led7_valuation", "quarters", "bars", "splits", sql=f"WITH {VALUATION} SELECT ticker, end_date, round(ps, 6) AS ps FROM v")
def valuation(quarters, bars, splits):
    """Price before the period's end, unadjusted by later splits, times a million shares, over trailing revenue."""
    return f.price_to_sales(quarters, bars, splits).select("ticker", "end_date", r6("ps").alias("ps"))


@query("led8_ps_vs_median", "quarters", "bars", "splits", sql=f"WITH {VALUATION}, m AS (SELECT ticker, end_date, ps, CASE WHEN count(ps) OVER w >= 4 THEN quantile_cont(ps, 0.5) OVER w END AS med FROM v WINDOW w AS (PARTITION BY ticker ORDER BY end_date RANGE BETWEEN INTERVAL 1095 DAY PRECEDING AND CURRENT ROW)) SELECT ticker, end_date, round(med, 6) AS median_ps, round(100 * (ps / med - 1), 5) AS versus_median_pct FROM m")
def ps_vs_median(quarters, bars, splits):
    v = f.price_to_sales(quarters, bars, splits)
    w = Window.partitionBy("ticker").orderBy(F.unix_date("end_date")).rangeBetween(-1095, 0)
    m = F.when(F.count("ps").over(w) >= 4, F.percentile("ps", F.lit(0.5)).over(w))
    return v.withColumn("med", m).select("ticker", "end_date", r6("med").alias("median_ps"), F.round(100 * (F.try_divide("ps", "med") - 1), 5).alias("versus_median_pct"))


@query("led9_depressed_screen", "bars", "quarters", "sic", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars), p AS (SELECT ticker, max(close) FILTER (back = 1) AS last_close, 1 - max(close) FILTER (back = 1) / max(close) FILTER (back <= 756) AS dd, avg(close * volume) FILTER (back <= 20) AS dv FROM r GROUP BY ticker HAVING count(*) >= 260),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS k FROM quarters), g AS (SELECT ticker, sum(revenue) FILTER (k <= 4) AS a, sum(revenue) FILTER (k BETWEEN 5 AND 8) AS b, sum(net_income) FILTER (k <= 4) AS ni FROM k WHERE k <= 8 GROUP BY ticker HAVING count(*) = 8)
    SELECT p.ticker, round(100 * dd, 4) AS drawdown_pct, round(100.0 * (a - b) / b, 4) AS growth_pct FROM p JOIN g ON g.ticker = p.ticker JOIN sic ON sic.ticker = p.ticker WHERE dd >= 0.1 AND last_close >= 3 AND dv >= 100 AND ni > 0 AND NOT starts_with(code, '28')""")
def depressed(bars, quarters, sic):
    from tapelab.plans.aggregates import ttm_snapshot
    from tapelab.plans.features import price_metrics

    p = price_metrics(bars).select("ticker", "last_close", "high_3y", "dollar_20").withColumn("dd", 1 - F.col("last_close") / F.col("high_3y")).filter("dd >= 0.1 and last_close >= 3 and dollar_20 >= 100")
    g = ttm_snapshot(quarters).filter("net_margin_pct > 0").select("ticker", "growth_pct")
    return p.join(g, "ticker").join(sic.filter(~F.col("code").startswith("28")), "ticker").select("ticker", F.round(100 * F.col("dd"), 4).alias("drawdown_pct"), "growth_pct")


@query("win28_stage", "quarters", sql=f"SELECT ticker, end_date, {STAGE} AS stage FROM quarters")
def stage(quarters):
    return f.with_stage(quarters).select("ticker", "end_date", "stage")


@query("win29_crossing", "quarters", sql=f"""WITH g AS (SELECT ticker, end_date, net_income, {STAGE} AS stage FROM quarters), x AS (SELECT *, row_number() OVER w AS nth, count(*) OVER b4 AS before_n, count(*) FILTER (stage <= 1) OVER (PARTITION BY ticker ORDER BY end_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS low_4, coalesce(sum(net_income) OVER b4, 0) AS prior_ni,
    count(*) OVER af AS after_n, min(stage) OVER af AS least_after, last_value(stage) OVER af AS last_stage, count(*) FILTER (stage = 2) OVER af AS wobbles FROM g WINDOW w AS ({QW}), b4 AS ({QW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), af AS ({QW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT ticker, min(end_date) AS crossing FROM x WHERE stage = 3 AND before_n >= 4 AND low_4 >= 2 AND prior_ni <= 5000000000 AND after_n >= 2 AND least_after >= 0 AND last_stage >= 1 AND wobbles <= 8 GROUP BY ticker""")
def crossing(quarters):
    return f.crossing(f.with_stage(quarters), share=0.5, max_prior=5_000_000_000, least_after=0, last_stage=1, wobbles=8)


@query("win30_failure", "quarters", sql=f"WITH g AS (SELECT *, {STAGE} AS stage, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS back FROM quarters) SELECT ticker, round(sum(greatest(revenue, 0))::DOUBLE / (-sum(least(net_income, 0)))::DOUBLE, 6) AS ratio FROM g GROUP BY ticker HAVING count(*) >= 8 AND max(revenue) > 0 AND sum(least(net_income, 0)) < 0 AND sum(net_income) FILTER (back <= 8) <= 50000000000 AND sum(greatest(revenue, 0)) <= 20 * -sum(least(net_income, 0))")
def failure(quarters):
    return f.failures(f.with_stage(quarters), never=4, max_tail=50_000_000_000, max_ratio=20).select("ticker", r6("ratio").alias("ratio"))


RUNWAY = "CASE WHEN operating_cf - capex >= 0 THEN '40-100' WHEN revenue IS NULL THEN '0-40' WHEN revenue < 4 * (capex - operating_cf) THEN '0-25' WHEN revenue < 8 * (capex - operating_cf) THEN '10-45' WHEN revenue < 16 * (capex - operating_cf) THEN '25-65' ELSE '40-80' END"


@query("led16_runway", "quarters", sql=f"SELECT ticker, end_date, {RUNWAY} AS band FROM quarters")
def runway(quarters):
    return quarters.select("ticker", "end_date", f.runway_band(F.col("operating_cf") - F.col("capex"), F.col("revenue")).alias("band"))


@query("led19_fact_sheet", "bars", "quarters", "sic", sql="WITH p AS (SELECT ticker, max(date) AS last_date, round(max_by(close, date), 6) AS last_close FROM bars GROUP BY ticker), q AS (SELECT ticker, count(*) AS quarters, CAST(sum(revenue) AS BIGINT) AS revenue FROM quarters GROUP BY ticker) SELECT p.ticker, last_date, last_close, quarters, revenue, code FROM p LEFT JOIN q ON q.ticker = p.ticker LEFT JOIN sic ON sic.ticker = p.ticker")
def fact_sheet(bars, quarters, sic):
    p = bars.groupBy("ticker").agg(F.max("date").alias("last_date"), r6(F.max_by("close", "date")).alias("last_close"))
    q = quarters.groupBy("ticker").agg(F.count(F.lit(1)).alias("quarters"), F.sum("revenue").alias("revenue"))
    return p.join(q, "ticker", "left").join(sic, "ticker", "left")


@query("led20_score_matrix", "quarters", sql=f"SELECT ticker, string_agg(CAST({STAGE} AS VARCHAR), ',' ORDER BY end_date) AS stages FROM quarters GROUP BY ticker")
def score_matrix(quarters):
    cells = F.array_sort(F.collect_list(F.struct("end_date", "stage")))
    return f.with_stage(quarters).groupBy("ticker").agg(F.array_join(F.transform(cells, lambda c: c["stage"].cast("string")), ",").alias("stages"))
