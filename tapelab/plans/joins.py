"""Joins (JON) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators.asof import asof_join, bucketed_range_join
from tapelab.operators.events import event_to_bar
from tapelab.operators.outcomes import forward_by_time, path_join
from tapelab.operators.windows import W, r6
from tapelab.plans import sqltext as s
from tapelab.plans.features import EVENT_BAR_SQL
from tapelab.plans.labels import NTH
from tapelab.plans.registry import query


@query("jon1_inner", "quarters", "filings", sql="SELECT q.ticker, q.end_date, revenue, filing_date FROM quarters AS q JOIN filings AS f ON f.ticker = q.ticker AND f.end_date = q.end_date")
def inner(quarters, filings):
    return quarters.join(filings, ["ticker", "end_date"]).select("ticker", "end_date", "revenue", "filing_date")


@query("jon2_left", "quarters", "filings", "sic", sql="SELECT q.ticker, q.end_date, revenue, filing_date, code FROM quarters AS q LEFT JOIN filings AS f ON f.ticker = q.ticker AND f.end_date = q.end_date LEFT JOIN sic AS s ON s.ticker = q.ticker")
def left(quarters, filings, sic):
    return quarters.join(filings, ["ticker", "end_date"], "left").join(sic, "ticker", "left").select("ticker", "end_date", "revenue", "filing_date", "code")


@query("jon3_with_market", "scored", "index_bars", sql=f"WITH i AS (SELECT date, close / lag(close, 126) OVER ({s.BY}) - 1 AS m FROM index_bars) SELECT p.ticker, p.date, round(m, 6) AS market_126 FROM scored AS p LEFT JOIN i ON i.date = p.date")
def with_market(scored, index_bars):
    """The index has one row a day, whatever the number of tickers, so its side is broadcast when statistics show that it fits."""
    i = index_bars.select("date", (F.col("close") / F.lag("close", 126).over(W()) - 1).alias("m"))
    return scored.join(i, "date", "left").select("ticker", "date", r6("m").alias("market_126"))


@query("jon4_outer", "quarters", sql="WITH a AS (SELECT ticker, end_date, operating_cf FROM quarters WHERE extract(QUARTER FROM end_date) <> 1), b AS (SELECT ticker, end_date, capex FROM quarters WHERE extract(QUARTER FROM end_date) <> 3) SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.end_date, b.end_date) AS end_date, operating_cf, capex FROM a FULL JOIN b ON a.ticker = b.ticker AND a.end_date = b.end_date")
def outer(quarters):
    a = quarters.filter(F.quarter("end_date") != 1).select("ticker", "end_date", "operating_cf")
    b = quarters.filter(F.quarter("end_date") != 3).select("ticker", "end_date", "capex")
    return a.join(b, ["ticker", "end_date"], "full")


@query("jon6_asof_forward_tolerance", "ticks", sql="SELECT event_id, ticker, round(first_value(price) OVER (PARTITION BY ticker ORDER BY us RANGE BETWEEN 3600000000 FOLLOWING AND 7200000000 FOLLOWING), 6) AS later FROM ticks")
def asof_forward(ticks):
    return forward_by_time(ticks, 3_600_000_000, 3_600_000_000).select("event_id", "ticker", r6("later").alias("later"))


@query("jon7_asof_strict_before", "filings", "bars", sql="SELECT f.ticker, f.filing_date, round((SELECT max_by(b.close, b.date) FROM bars AS b WHERE b.ticker = f.ticker AND b.date < f.filing_date), 6) AS close_before FROM filings AS f")
def strict_before(filings, bars):
    return asof_join(filings, bars.select("ticker", "date", "close"), "ticker", "filing_date", "date", inclusive=False).select("ticker", "filing_date", r6("match.close").alias("close_before"))


@query("jon9_announce_dates", "quarters", "filings", sql="WITH m AS (SELECT q.ticker, q.end_date, min(f.filing_date) AS first_filing FROM quarters AS q LEFT JOIN filings AS f ON f.ticker = q.ticker AND f.filing_date > q.end_date AND f.filing_date <= q.end_date + 100 GROUP BY 1, 2) SELECT ticker, end_date, CASE WHEN first_filing <= end_date + 40 THEN first_filing ELSE end_date + 40 END AS announced, CASE WHEN first_filing <= end_date + 40 THEN '8-K' ELSE 'filed' END AS source FROM m")
def announce(quarters, filings):
    """The first filing in (end, end + 100 days], unless the report itself (40 days after the end) came first."""
    j = asof_join(quarters.select("ticker", "end_date"), filings.select("ticker", "filing_date"), "ticker", "end_date", "filing_date", "forward", inclusive=False)
    report = F.date_add("end_date", 40)
    early = F.coalesce((F.col("match.filing_date") <= report) & (F.datediff("match.filing_date", "end_date") <= 100), F.lit(False))
    return j.select("ticker", "end_date", F.when(early, F.col("match.filing_date")).otherwise(report).alias("announced"), F.when(early, "8-K").otherwise("filed").alias("source"))


@query("jon10_event_to_bar", "earnings", "bars", sql=f"WITH {NTH}, {EVENT_BAR_SQL} SELECT ticker, earnings_date, report_time, bar_at AS at, reaction FROM r")
def event_bar(earnings, bars):
    e = event_to_bar(earnings, bars.select("ticker", "date", F.row_number().over(W()).alias("nth")))
    return e.select("ticker", "earnings_date", "report_time", "at", "reaction")


@query("jon11_event_to_bar_always", "earnings", "bars", sql=f"WITH {NTH}, {EVENT_BAR_SQL} SELECT ticker, earnings_date, bar_at + CASE WHEN report_time = 'AMC' THEN 1 ELSE 0 END AS reaction FROM r")
def event_bar_always(earnings, bars):
    e = event_to_bar(earnings, bars.select("ticker", "date", F.row_number().over(W()).alias("nth")), shift_rolled=True)
    return e.select("ticker", "earnings_date", "reaction")


@query("jon12_assign_windows", "scored", sql="WITH w AS (SELECT k AS window_id, DATE '1994-01-01' + CAST(k * 120 AS INTEGER) AS start_date, DATE '1994-01-01' + CAST(k * 120 + 300 AS INTEGER) AS end_date FROM (SELECT unnest(generate_series(0, 11)) AS k) AS g) SELECT window_id, count(*) AS n, count(DISTINCT ticker) AS tickers FROM scored JOIN w ON date >= start_date AND date < end_date GROUP BY window_id")
def assign_windows(scored):
    """Few windows, many rows: the windows' side is a fixed dozen of rows and is broadcast."""
    w = scored.sparkSession.range(12).select(F.col("id").alias("window_id"), F.expr("date_add(date'1994-01-01', cast(id * 120 as int))").alias("start_date"), F.expr("date_add(date'1994-01-01', cast(id * 120 + 300 as int))").alias("end_date"))
    j = scored.join(F.broadcast(w), (F.col("date") >= F.col("start_date")) & (F.col("date") < F.col("end_date")))
    return j.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"))


@query("jon14_lookback_join", "earnings", "news", sql="SELECT e.ticker, e.earnings_date, count(n.article_id) AS articles, CAST(coalesce(sum(n.sentiment), 0) AS BIGINT) AS total FROM (SELECT DISTINCT ticker % 10 AS ticker, CAST(earnings_date + INTERVAL 29 YEAR AS DATE) AS earnings_date FROM earnings) AS e JOIN news AS n ON n.ticker % 10 = e.ticker AND CAST(n.published AS DATE) >= e.earnings_date - 30 AND CAST(n.published AS DATE) <= e.earnings_date GROUP BY 1, 2")
def lookback(earnings, news):
    """All articles of the 30 days up to an event, both ends included. They are summed by day before they meet events."""
    e = earnings.select((F.col("ticker") % 10).alias("ticker"), F.add_months("earnings_date", 12 * 29).alias("earnings_date")).distinct().withColumn("low", F.date_sub("earnings_date", 30))
    n = news.groupBy((F.col("ticker") % 10).alias("ticker"), F.to_date("published").alias("day")).agg(F.count("article_id").alias("articles"), F.sum("sentiment").alias("total"))
    j = bucketed_range_join(n, e, "ticker", "day", "low", "earnings_date", 30)
    return j.groupBy("ticker", "earnings_date").agg(F.sum("articles").alias("articles"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))


PREFIXES = (("1", "resources"), ("13", "oil"), ("2", "makers"), ("28", "chemicals"), ("5", "trade"), ("59", "retail"), ("8", "services"))


@query("jon15_longest_prefix", "sic", sql="SELECT ticker, code, coalesce((SELECT max_by(g, length(p)) FROM (VALUES " + ", ".join(map(str, PREFIXES)) + ") AS m(p, g) WHERE starts_with(code, p)), 'other') AS sector FROM sic")
def longest_prefix(sic):
    """Each code's prefixes meet the map in an equi join; the longest match wins."""
    m = sic.sparkSession.createDataFrame(PREFIXES, "p string, g string")
    x = sic.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring(F.col("code"), F.lit(1), n)))).join(F.broadcast(m), "p", "left")
    return x.groupBy("ticker", "code").agg(F.coalesce(F.max_by("g", F.when(F.col("g").isNotNull(), F.length("p"))), F.lit("other")).alias("sector"))


@query("jon16_yoy", "quarters", sql="SELECT a.ticker, a.end_date, a.revenue, b.revenue AS last_year, round(100.0 * (a.revenue - b.revenue) / b.revenue, 4) AS yoy_pct FROM quarters AS a JOIN quarters AS b ON b.ticker = a.ticker AND b.end_date = (SELECT min(c.end_date) FROM quarters AS c WHERE c.ticker = a.ticker AND c.end_date BETWEEN a.end_date - 380 AND a.end_date - 350)")
def yoy(quarters):
    """The earliest period that ended 350 to 380 days before: a range frame in days, no self join."""
    w = Window.partitionBy("ticker").orderBy(F.unix_date("end_date")).rangeBetween(-380, -350)
    t = quarters.withColumn("last_year", F.first("revenue").over(w)).filter("last_year is not null")
    return t.select("ticker", "end_date", "revenue", "last_year", F.round(F.try_divide(F.lit(100.0) * (F.col("revenue") - F.col("last_year")), F.col("last_year")), 4).alias("yoy_pct"))


@query("jon17_outstanding", "documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def outstanding(documents, labels):
    return documents.join(labels, "doc_id", "left_anti").select("doc_id")


@query("jon19_unadjust", "bars", "splits", sql="SELECT b.ticker, b.date, round(close * coalesce((SELECT product(ratio) FROM splits AS s WHERE s.ticker = b.ticker AND s.split_date > b.date), 1), 6) AS raw_close FROM bars AS b")
def unadjust(bars, splits):
    """Products of later ratios: splits are put among the bars and multiplied up from the end, without pairs."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    both = bars.select("ticker", "date", F.lit(1).alias("k"), "close", F.lit(1.0).alias("ratio")).unionByName(splits.select("ticker", F.col("split_date").alias("date"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("close"), "ratio"))
    return both.withColumn("f", F.coalesce(F.product("ratio").over(w), F.lit(1.0))).filter("k = 1").select("ticker", "date", r6(F.col("close") * F.col("f")).alias("raw_close"))
