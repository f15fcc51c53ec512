"""Valuations, rises since events and best runs (LED6, LED7, LED9, LBL11, LBL13, LBL14) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.operators import valuation as v
from tapelab.operators.windows import r6
from tapelab.plans.joins import announce
from tapelab.plans.registry import query

SHARES = """sd AS (SELECT *, end_date - start_date AS days FROM share_facts),
    sq AS (SELECT ticker, end_date, min_by(val, filed) AS shares FROM sd WHERE days BETWEEN 80 AND 100 GROUP BY 1, 2), sy AS (SELECT ticker, end_date, min_by(val, filed) AS shares FROM sd WHERE days BETWEEN 350 AND 380 GROUP BY 1, 2),
    sh AS (SELECT * FROM sq UNION ALL SELECT * FROM sy WHERE NOT EXISTS (SELECT 1 FROM sq WHERE sq.ticker = sy.ticker AND sq.end_date = sy.end_date))"""
ANNOUNCED = "an AS (SELECT q.ticker, q.end_date, CASE WHEN min(f.filing_date) <= q.end_date + 40 THEN min(f.filing_date) ELSE q.end_date + 40 END AS announced FROM quarters AS q LEFT JOIN filings AS f ON f.ticker = q.ticker AND f.filing_date > q.end_date AND f.filing_date <= q.end_date + 100 GROUP BY 1, 2)"
VALUES = f"""{SHARES}, {ANNOUNCED},
    v0 AS (SELECT ticker, end_date, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(revenue) OVER w AS BIGINT) END AS ttm_revenue, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(operating_cf - capex) OVER w AS BIGINT) END AS ttm_fcf FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    v1 AS (SELECT v0.*, an.announced FROM v0 JOIN an ON an.ticker = v0.ticker AND an.end_date = v0.end_date WHERE ttm_revenue IS NOT NULL),
    v2 AS (SELECT v1.*, sh.shares FROM v1 ASOF JOIN sh ON sh.ticker = v1.ticker AND sh.end_date <= v1.end_date WHERE v1.end_date - sh.end_date <= 120),
    v3 AS (SELECT v2.*, b.close, b.date AS priced FROM v2 ASOF JOIN bars AS b ON b.ticker = v2.ticker AND b.date < v2.announced),
    v4 AS (SELECT *, close * coalesce((SELECT product(ratio) FROM splits AS s WHERE s.ticker = v3.ticker AND s.split_date > v3.priced), 1) * shares AS mcap FROM v3),
    mv AS (SELECT *, CASE WHEN ttm_revenue > 0 THEN mcap / ttm_revenue END AS ps, CASE WHEN ttm_fcf > 0 THEN mcap / ttm_fcf END AS p_fcf FROM v4),
    latest AS (SELECT ticker, max_by(close, date) AS close FROM bars GROUP BY ticker),
    pn AS (SELECT m.ticker, m.ps * l.close / m.close AS ps_now FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS k FROM mv) AS m JOIN latest AS l ON l.ticker = m.ticker WHERE k = 1)"""
SECTOR = "sb AS (SELECT substr(code, 1, 2) AS sector, date, avg(close) AS close FROM bars JOIN sic ON sic.ticker = bars.ticker GROUP BY 1, 2)"


def _weekly_sql(table: str, by: str) -> str:
    return f"SELECT {by}, date_trunc('week', date) AS week, max(date) AS date, max_by(close, date) AS close FROM {table} GROUP BY 1, 2"


def _values(quarters, filings, bars, share_facts, splits):
    return v.market_values(quarters, announce(quarters, filings), bars, v.diluted_shares(share_facts), splits)


def _sector_bars(bars, sic):
    s = sic.select("ticker", F.substring("code", 1, 2).alias("sector"))
    return bars.join(s, "ticker").groupBy("sector", "date").agg(F.avg("close").alias("close"))


@query("led6_diluted_shares", "share_facts", sql=f"WITH {SHARES} SELECT * FROM sh")
def shares(share_facts):
    return v.diluted_shares(share_facts)


@query("led7_market_values", "quarters", "filings", "bars", "share_facts", "splits", sql=f"WITH {VALUES} SELECT ticker, end_date, announced, round(mcap / 1000, 3) AS mcap_thousand, round(ps, 9) AS ps, round(p_fcf, 9) AS p_fcf FROM mv")
def market_values(quarters, filings, bars, share_facts, splits):
    t = _values(quarters, filings, bars, share_facts, splits)
    return t.select("ticker", "end_date", "announced", F.round(F.col("mcap") / 1000, 3).alias("mcap_thousand"), F.round("ps", 9).alias("ps"), F.round("p_fcf", 9).alias("p_fcf"))


@query("led7_current_ps", "quarters", "filings", "bars", "share_facts", "splits", sql=f"WITH {VALUES} SELECT ticker, round(ps_now, 9) AS ps_now FROM pn")
def current_ps(quarters, filings, bars, share_facts, splits):
    return v.current_ps(_values(quarters, filings, bars, share_facts, splits), bars).select("ticker", F.round("ps_now", 9).alias("ps_now"))


@query(
    "lbl13_rise_since_announcement", "quarters", "filings", "bars", "share_facts", "splits", "sic",
    sql=f"""WITH {VALUES}, {SECTOR}, wk AS ({_weekly_sql('bars', 'ticker')}), sw AS ({_weekly_sql('sb', 'sector')}), wl AS (SELECT ticker, max_by(close, date) AS now_ FROM wk GROUP BY 1), sl AS (SELECT sector, max_by(close, date) AS now_ FROM sw GROUP BY 1),
        a0 AS (SELECT an.*, substr(sic.code, 1, 2) AS sector FROM an JOIN sic ON sic.ticker = an.ticker),
        a1 AS (SELECT a0.*, 100 * (wl.now_ / wk.close - 1) AS rise FROM a0 ASOF LEFT JOIN wk ON wk.ticker = a0.ticker AND wk.date < a0.announced LEFT JOIN wl ON wl.ticker = a0.ticker),
        a2 AS (SELECT a1.*, 100 * (sl.now_ / sw.close - 1) AS sector_rise FROM a1 ASOF LEFT JOIN sw ON sw.sector = a1.sector AND sw.date < a1.announced LEFT JOIN sl ON sl.sector = a1.sector),
        a3 AS (SELECT a2.*, mv.ps AS ps_then FROM a2 ASOF LEFT JOIN mv ON mv.ticker = a2.ticker AND mv.end_date >= a2.end_date)
        SELECT a3.ticker, a3.end_date, announced, round(rise, 5) AS rise_pct, round(sector_rise, 5) AS sector_rise_pct, round(100 * ((1 + rise / 100) / (1 + sector_rise / 100) - 1), 5) AS relative_pct, round(ps_then, 9) AS ps_then, round(ps_now, 9) AS ps_now, round(100 * (ps_now / ps_then - 1), 4) AS ps_change_pct FROM a3 LEFT JOIN pn ON pn.ticker = a3.ticker""",
)
def rise(quarters, filings, bars, share_facts, splits, sic):
    """Every announcement: the rise since, of the stock and of its sector, and price to sales then (of the first quarter from there on) and now."""
    from tapelab.operators.asof import asof_join

    values = _values(quarters, filings, bars, share_facts, splits)
    e = announce(quarters, filings).select("ticker", "end_date", "announced").join(sic.select("ticker", F.substring("code", 1, 2).alias("sector")), "ticker")
    t = v.rise_since(e, v.weekly(bars), "ticker", "announced", "rise")
    t = v.rise_since(t, v.weekly(_sector_bars(bars, sic), "sector"), "sector", "announced", "sector_rise")
    t = asof_join(t, values.select("ticker", F.col("end_date").alias("then_end"), "ps"), "ticker", "end_date", "then_end", "forward").withColumn("ps_then", F.col("match.ps")).drop("match")
    t = t.join(v.current_ps(values, bars), "ticker", "left")
    r5 = lambda c: F.round(c, 5)
    return t.select(
        "ticker", "end_date", "announced", r5(F.col("rise")).alias("rise_pct"), r5(F.col("sector_rise")).alias("sector_rise_pct"), r5(v.relative_pct(F.col("rise"), F.col("sector_rise"))).alias("relative_pct"),
        F.round("ps_then", 9).alias("ps_then"), F.round("ps_now", 9).alias("ps_now"), F.round(100 * (F.try_divide("ps_now", "ps_then") - 1), 4).alias("ps_change_pct"),
    )


def _forward_sql(rows: str, table: str, by: str, as_of: str, months=v.MONTHS) -> str:
    """CTEs fwN: ``rows`` with ret_6m, ... as :func:`valuation.forward_returns` has them."""
    out, last = [f"fw0 AS (SELECT r.*, b.close AS base FROM {rows} AS r ASOF LEFT JOIN {table} AS b ON b.{by} = r.{by} AND b.date <= r.{as_of})"], "fw0"
    for m in months:
        out.append(f"t{m} AS (SELECT *, CAST({as_of} + to_months({m}) AS DATE) AS target FROM {last})")
        out.append(f"fw{m} AS (SELECT t.* EXCLUDE (target), CASE WHEN b.date - t.target < 10 THEN 100 * (b.close / t.base - 1) END AS ret_{m}m FROM t{m} AS t ASOF LEFT JOIN {table} AS b ON b.{by} = t.{by} AND b.date >= t.target)")
        last = f"fw{m}"
    out.append(f"fw AS (SELECT t.* EXCLUDE (base), 100 * (l.now_ / t.base - 1) AS ret_now FROM {last} AS t LEFT JOIN (SELECT {by}, max_by(close, date) AS now_ FROM {table} GROUP BY 1) AS l ON l.{by} = t.{by})")
    return ", ".join(out)


@query("lbl11_fwd_months", "filings", "bars", sql=f"WITH f AS (SELECT ticker, filing_date FROM filings), {_forward_sql('f', 'bars', 'ticker', 'filing_date')} SELECT ticker, filing_date, round(ret_6m, 5) AS ret_6m, round(ret_12m, 5) AS ret_12m, round(ret_24m, 5) AS ret_24m, round(ret_now, 5) AS ret_now FROM fw")
def fwd_months(filings, bars):
    t = v.forward_returns(filings.select("ticker", "filing_date"), bars, "ticker", "filing_date")
    return t.select("ticker", "filing_date", *(F.round(c, 5).alias(c) for c in ("ret_6m", "ret_12m", "ret_24m", "ret_now")))


AS_OF = "1998-06-30"


@query(
    "led9_depressed_as_of", "bars", "quarters", "filings", "sic",
    sql=f"""WITH {ANNOUNCED}, {SECTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars WHERE date <= DATE '{AS_OF}'), p AS (SELECT ticker, max(close) FILTER (back = 1) AS last_close, 1 - max(close) FILTER (back = 1) / max(close) FILTER (back <= 252) AS dd, avg(close * volume) FILTER (back <= 20) AS dv FROM r GROUP BY ticker HAVING count(*) >= 60),
        k AS (SELECT q.*, row_number() OVER (PARTITION BY q.ticker ORDER BY q.end_date DESC) AS k FROM quarters AS q JOIN an ON an.ticker = q.ticker AND an.end_date = q.end_date WHERE an.announced <= DATE '{AS_OF}'), g AS (SELECT ticker, sum(revenue) FILTER (k <= 4) AS a, sum(revenue) FILTER (k BETWEEN 5 AND 8) AS b, sum(net_income) FILTER (k <= 4) AS ni, sum(operating_cf - capex) FILTER (k <= 4) AS fcf FROM k WHERE k <= 8 GROUP BY ticker HAVING count(*) = 8),
        s AS (SELECT p.ticker, substr(code, 1, 2) AS sector, DATE '{AS_OF}' AS as_of, round(100 * dd, 4) AS drawdown_pct, round(100.0 * (a - b) / b, 4) AS growth_pct FROM p JOIN g ON g.ticker = p.ticker JOIN sic ON sic.ticker = p.ticker WHERE dd >= 0.05 AND last_close >= 3 AND dv >= 100 AND ni > -1000000000 AND NOT starts_with(code, '28')),
        {_forward_sql('s', 'bars', 'ticker', 'as_of')}, fs AS (SELECT DISTINCT sector, as_of FROM s), {_forward_sql('fs', 'sb', 'sector', 'as_of', (12,)).replace('fw', 'sf').replace('t12', 'u12')}
        SELECT fw.ticker, fw.sector, drawdown_pct, growth_pct, round(fw.ret_6m, 5) AS ret_6m, round(fw.ret_12m, 5) AS ret_12m, round(fw.ret_24m, 5) AS ret_24m, round(fw.ret_now, 5) AS ret_now, round(fw.ret_12m - sf.ret_12m, 5) AS ret_12m_vs_sector FROM fw LEFT JOIN sf ON sf.sector = fw.sector""",
)
def depressed_as_of(bars, quarters, filings, sic):
    """The screen on one day, with prices and announcements up to then only, and what came after: own returns and those over the sector's."""
    day = F.lit(AS_OF).cast("date")
    from pyspark.sql import Window

    by = Window.partitionBy("ticker")
    past = bars.filter(F.col("date") <= day).withColumns({"back": F.row_number().over(by.orderBy(F.desc("date"))), "n": F.count(F.lit(1)).over(by)}).filter("n >= 60")
    within = lambda k, c: F.when(F.col("back") <= k, c)
    p = past.groupBy("ticker").agg(F.max(within(1, F.col("close"))).alias("last_close"), F.max(within(252, F.col("close"))).alias("high"), F.avg(within(20, F.col("close") * F.col("volume"))).alias("dv")).withColumn("dd", 1 - F.col("last_close") / F.col("high"))
    known = quarters.join(announce(quarters, filings).filter(F.col("announced") <= day).select("ticker", "end_date"), ["ticker", "end_date"])
    k = known.withColumn("k", F.row_number().over(by.orderBy(F.desc("end_date")))).filter("k <= 8")
    some = lambda c, a, b: F.sum(F.when(F.col("k").between(a, b), F.col(c)))
    g = k.groupBy("ticker").agg(some("revenue", 1, 4).alias("a"), some("revenue", 5, 8).alias("b"), some("net_income", 1, 4).alias("ni"), F.count(F.lit(1)).alias("n")).filter("n = 8")
    s = p.filter("dd >= 0.05 and last_close >= 3 and dv >= 100").join(g.filter("ni > -1000000000"), "ticker").join(sic.filter(~F.col("code").startswith("28")), "ticker")
    s = s.select("ticker", F.substring("code", 1, 2).alias("sector"), day.alias("as_of"), F.round(100 * F.col("dd"), 4).alias("drawdown_pct"), F.round(F.lit(100.0) * (F.col("a") - F.col("b")) / F.col("b"), 4).alias("growth_pct"))
    own = v.forward_returns(s, bars, "ticker", "as_of")
    sector = v.forward_returns(s.select("sector", "as_of").distinct(), _sector_bars(bars, sic), "sector", "as_of", (12,)).select("sector", F.col("ret_12m").alias("sector_12m"))
    t = own.join(sector, "sector", "left").withColumn("ret_12m_vs_sector", F.col("ret_12m") - F.col("sector_12m"))
    return t.select("ticker", "sector", "drawdown_pct", "growth_pct", *(F.round(c, 5).alias(c) for c in ("ret_6m", "ret_12m", "ret_24m", "ret_now", "ret_12m_vs_sector")))


_JUMP, _N, _TIMES = 1.08, 126, 1.2


@query("lbl14_best_run_by_segment", "bars", sql=f"""WITH j AS (SELECT *, CASE WHEN close / lag(close) OVER w > {_JUMP}::DOUBLE OR close / lag(close) OVER w < 1 / {_JUMP}::DOUBLE THEN 1 ELSE 0 END AS jump FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    g AS (SELECT *, sum(jump) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM j),
    p AS (SELECT *, row_number() OVER s AS nth, quantile_cont(close, 0.5) OVER (s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p, CASE WHEN count(volume) OVER (s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 5 THEN avg(close * volume) OVER (s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS dollar FROM g WINDOW s AS (PARTITION BY ticker, segment ORDER BY date)),
    f AS (SELECT *, max(p) OVER (s ROWS BETWEEN 1 FOLLOWING AND {_N} FOLLOWING) AS top, last_value(p) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_price FROM p WINDOW s AS (PARTITION BY ticker, segment ORDER BY date)),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(top / p, 9) DESC, date) AS k FROM f WHERE close >= 1 AND dollar >= 100 AND top / p >= {_TIMES}::DOUBLE),
    b AS (SELECT * FROM k WHERE k = 1),
    x AS (SELECT b.ticker, min(f.nth) FILTER (round(f.p, 9) = round(b.top, 9)) AS peak_nth, min(f.date) FILTER (round(f.p, 9) = round(b.top, 9)) AS peak_date, min(f.date) FILTER (f.p >= b.p * {_TIMES}::DOUBLE) AS cross_date FROM b JOIN f ON f.ticker = b.ticker AND f.segment = b.segment AND f.nth BETWEEN b.nth + 1 AND b.nth + {_N} GROUP BY b.ticker)
    SELECT b.ticker, b.date AS start_date, round(b.p, 6) AS start_price, peak_date, round(top, 6) AS peak_price, round(top / b.p, 6) AS multiple, peak_nth - b.nth AS days_to_peak, cross_date, round(last_price, 6) AS last_price, round(100 * (last_price / top - 1), 5) AS last_vs_peak_pct, round(last_price / b.p, 6) AS current_multiple FROM b JOIN x ON x.ticker = b.ticker""")
def best_run(bars):
    t = v.best_run_by_segment(bars, _TIMES, _N, 1.0, 100.0, 5, _JUMP)
    return t.select("ticker", "start_date", r6("start_price").alias("start_price"), "peak_date", r6("peak_price").alias("peak_price"), r6("multiple").alias("multiple"), "days_to_peak", "cross_date", r6("last_price").alias("last_price"), F.round("last_vs_peak_pct", 5).alias("last_vs_peak_pct"), r6("current_multiple").alias("current_multiple"))
