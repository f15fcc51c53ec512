"""Projections and filters (PRJ), top-k (TOP) and set operations (SET) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import outcomes
from tapelab.operators.windows import W, frame, r6
from tapelab.plans import sqltext as s
from tapelab.plans.labels import CUT
from tapelab.plans.registry import query


def half_open(df, col, start, end):
    return df.filter((F.col(col) >= F.lit(start).cast("date")) & (F.col(col) < F.lit(end).cast("date")))


@query("prj1_slice", "bars", sql="SELECT ticker, date, round(close, 6) AS close FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-01'")
def slice_(bars):
    return half_open(bars, "date", "1996-01-01", "1997-01-01").select("ticker", "date", r6("close").alias("close"))


@query("prj2_complete_cases", "panel", sql="SELECT ticker, date FROM panel WHERE ret_21 IS NOT NULL AND drawdown IS NOT NULL AND fwd_ret IS NOT NULL")
def complete(panel):
    return panel.dropna(subset=["ret_21", "drawdown", "fwd_ret"]).select("ticker", "date")


@query("prj3_sample_every", "bars", sql=f"SELECT ticker, date FROM (SELECT *, row_number() OVER ({s.BY}) AS nth FROM bars) AS x WHERE nth > 60 AND (nth - 1 - 60) % 21 = 0")
def sample_every(bars):
    return bars.withColumn("nth", F.row_number().over(W())).filter("nth > 60 and (nth - 1 - 60) % 21 = 0").select("ticker", "date")


@query("prj4_eligible", "bars", sql=f"SELECT ticker, date FROM (SELECT ticker, date, close, CASE WHEN count(close * volume) OVER {s.over(-19, 0)} >= 5 THEN avg(close * volume) OVER {s.over(-19, 0)} END AS dv FROM bars) AS x WHERE close >= 15 AND dv >= 400")
def eligible(bars):
    d, w = F.col("close") * F.col("volume"), frame(-19, 0)
    return bars.withColumn("dv", F.when(F.count(d).over(w) >= 5, F.avg(d).over(w))).filter("close >= 15 and dv >= 400").select("ticker", "date")


@query("prj5_min_base", "bars", sql="SELECT ticker, date FROM bars WHERE close >= 10")
def min_base(bars):
    return bars.filter("close >= 10").select("ticker", "date")


@query("prj6_min_rows", "bars", sql="SELECT ticker, count(*) AS n FROM bars GROUP BY ticker HAVING count(*) >= 300")
def min_rows(bars):
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter("n >= 300")


@query("prj7_uncensored", "bars", sql=f"WITH {CUT}, d AS (SELECT ticker, max(date) < (SELECT max(date) FROM cut) - 14 AS delisted FROM cut GROUP BY ticker), x AS (SELECT ticker, date, count(*) OVER {s.over(1, 63)} AS ahead FROM cut) SELECT x.ticker, x.date, ahead, delisted FROM x JOIN d ON d.ticker = x.ticker WHERE ahead = 63 OR delisted")
def uncensored(bars):
    cut = outcomes.cut_archive(bars)
    x = cut.select("ticker", "date", F.count(F.lit(1)).over(frame(1, 63)).alias("ahead"))
    return x.join(outcomes.delisted(cut, 14).select("ticker", "delisted"), "ticker").filter("ahead = 63 or delisted")


@query("prj8_as_of_filter", "facts", sql="SELECT ticker, concept, end_date, max(val) AS val FROM facts WHERE filed <= DATE '1996-06-30' GROUP BY 1, 2, 3")
def as_of(facts):
    return facts.filter(F.col("filed") <= F.lit("1996-06-30").cast("date")).groupBy("ticker", "concept", "end_date").agg(F.max("val").alias("val"))


@query("prj9_drop_sic_prefix", "sic", sql="SELECT ticker, code FROM sic WHERE NOT (code LIKE '23%' OR code LIKE '8%')")
def drop_prefix(sic):
    """Each code's own prefixes meet the list in an equi join."""
    prefixes = sic.sparkSession.createDataFrame([("23",), ("8",)], "prefix string")
    own = sic.select("ticker", "code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring(F.col("code"), F.lit(1), n))).alias("prefix"))
    hit = own.join(prefixes, "prefix", "left_semi").select("ticker", "code").distinct()
    return sic.join(hit, ["ticker", "code"], "left_anti").select("ticker", "code")


@query("prj10_purged_split", "scored", sql="SELECT ticker, date, CASE WHEN date < DATE '1996-01-01' - 100 THEN 'train' ELSE 'test' END AS role FROM scored WHERE date < DATE '1996-01-01' - 100 OR date >= DATE '1996-01-01'")
def purged(scored):
    cut = F.lit("1996-01-01").cast("date")
    role = F.when(F.col("date") < F.date_sub(cut, 100), "train").when(F.col("date") >= cut, "test")
    return scored.select("ticker", "date", role.alias("role")).filter("role is not null")


@query("prj11_ticker_split", "scored", sql="SELECT role, count(DISTINCT ticker) AS tickers, count(*) AS n FROM (SELECT ticker, CASE WHEN (ticker * 2654435761) % 100 < 40 THEN 'test' ELSE 'train' END AS role FROM scored) AS x GROUP BY role")
def ticker_split(scored):
    role = F.when((F.col("ticker") * F.lit(2654435761)) % 100 < 40, "test").otherwise("train")
    return scored.groupBy(role.alias("role")).agg(F.countDistinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("n"))


@query("prj12_long_only", "scored", sql="SELECT ticker, date, round(CASE WHEN abs(score) < 0.02 THEN 0 ELSE greatest(score, 0) END, 6) AS position FROM scored")
def long_only(scored):
    return scored.select("ticker", "date", r6(F.when(F.abs("score") < 0.02, 0.0).otherwise(F.greatest("score", F.lit(0.0)))).alias("position"))


ORDER = "PARTITION BY year ORDER BY score DESC, ticker, date"


@query("top1_top_pct", "scored", sql=f"SELECT year, ticker, date FROM (SELECT *, row_number() OVER ({ORDER}) AS r, count(*) OVER (PARTITION BY year) AS n FROM scored) AS x WHERE r <= greatest(1, floor(n * 5 / 100))")
def top_pct(scored):
    w = Window.partitionBy("year")
    t = scored.withColumns({"r": F.row_number().over(w.orderBy(F.desc("score"), "ticker", "date")), "n": F.count(F.lit(1)).over(w)})
    return t.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * 5 / 100))).select("year", "ticker", "date")


@query("top2_topk_table", "scored", sql=f"WITH r AS (SELECT *, row_number() OVER ({ORDER}) AS r, count(*) OVER (PARTITION BY year) AS n, avg(label) OVER (PARTITION BY year) AS base FROM scored) SELECT year, CAST(p AS INTEGER) AS p, count(*) AS k, round(avg(label), 6) AS precision_, round(avg(label) / max(base), 6) AS lift, round(median(fwd_multiple), 6) AS median_multiple, round(avg(fwd_multiple), 6) AS mean_multiple FROM r CROSS JOIN (SELECT unnest([2, 5, 10]) AS p) AS v WHERE r <= greatest(1, floor(n * p / 100)) GROUP BY year, p HAVING max(base) > 0")
def topk_table(scored):
    w = Window.partitionBy("year")
    t = scored.withColumns({"r": F.row_number().over(w.orderBy(F.desc("score"), "ticker", "date")), "n": F.count(F.lit(1)).over(w), "base": F.avg("label").over(w)})
    t = t.withColumn("p", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10)))).filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.col("p") / 100)))
    return t.groupBy("year", "p").agg(F.count(F.lit(1)).alias("k"), r6(F.avg("label")).alias("precision_"), r6(F.try_divide(F.avg("label"), F.max("base"))).alias("lift"), r6(F.median("fwd_multiple")).alias("median_multiple"), r6(F.avg("fwd_multiple")).alias("mean_multiple")).filter("lift is not null")


@query("top3_drop_top", "scored", sql="SELECT ticker, count(*) AS n, round(avg(fwd_ret), 6) AS mean_ret FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fwd_ret DESC, date) AS r FROM scored) AS x WHERE r > 4 GROUP BY ticker")
def drop_top(scored):
    t = scored.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fwd_ret"), "date")))
    return t.filter("r > 4").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd_ret")).alias("mean_ret"))


@query("top4_rank_output", "scored", sql="SELECT ticker, date, round(fwd_multiple, 6) AS multiple FROM scored ORDER BY fwd_multiple DESC, ticker, date LIMIT 50")
def rank_output(scored):
    return scored.orderBy(F.desc("fwd_multiple"), "ticker", "date").limit(50).select("ticker", "date", r6("fwd_multiple").alias("multiple"))


@query("top5_tail_n", "quarters", sql="SELECT ticker, end_date, revenue FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC) AS r FROM quarters) AS x WHERE r <= 4")
def tail_n(quarters):
    return quarters.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("end_date")))).filter("r <= 4").select("ticker", "end_date", "revenue")


@query("top6_even_sample", "quarters", sql="WITH r AS (SELECT ticker, end_date, row_number() OVER (PARTITION BY ticker ORDER BY end_date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM quarters) SELECT ticker, end_date FROM r WHERE n <= 5 OR i IN (SELECT CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT) FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k) AS s)")
def even_sample(quarters):
    w = Window.partitionBy("ticker")
    t = quarters.select("ticker", "end_date", (F.row_number().over(w.orderBy("end_date")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    picks = F.array(*(F.bround(F.lit(k) * (F.col("n") - 1) / 4).cast("int") for k in range(5)))
    return t.filter((F.col("n") <= 5) | F.array_contains(picks, F.col("i"))).select("ticker", "end_date")


@query("set1_union_all", "bars", "index_bars", sql="SELECT ticker, date, round(close, 6) AS close FROM bars UNION ALL SELECT ticker, date, round(close, 6) FROM index_bars")
def union_all(bars, index_bars):
    return bars.select("ticker", "date", r6("close").alias("close")).unionByName(index_bars.select("ticker", "date", r6("close").alias("close")))


@query("set2_first_wins", "facts", sql="SELECT ticker, end_date, concept, val FROM (SELECT *, row_number() OVER (PARTITION BY ticker, end_date ORDER BY CASE concept WHEN 'OperatingCF' THEN 0 ELSE 1 END, filed, val) AS r FROM facts) AS x WHERE r = 1")
def first_wins(facts):
    w = Window.partitionBy("ticker", "end_date").orderBy(F.when(F.col("concept") == "OperatingCF", 0).otherwise(1), "filed", "val")
    return facts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("ticker", "end_date", "concept", "val")


@query("set3_verified_override", "quarters", "filings", sql="SELECT coalesce(q.ticker, f.ticker) AS ticker, coalesce(q.end_date, f.end_date) AS end_date, CASE WHEN q.ticker IS NULL OR q.net_income < 0 THEN coalesce(CAST(f.filing_date AS VARCHAR), 'none') ELSE CAST(q.revenue AS VARCHAR) END AS value FROM quarters AS q FULL JOIN filings AS f ON f.ticker = q.ticker AND f.end_date = q.end_date")
def verified_override(quarters, filings):
    """The first source where it is there and verified (here: not negative), else the second."""
    j = quarters.join(filings, ["ticker", "end_date"], "full")
    bad = F.col("revenue").isNull() | (F.col("net_income") < 0)
    return j.select("ticker", "end_date", F.when(bad, F.coalesce(F.col("filing_date").cast("string"), F.lit("none"))).otherwise(F.col("revenue").cast("string")).alias("value"))


@query("set4_except_terms", "documents", "benchmark", sql=r"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents WHERE source = 'src1') SELECT term FROM t WHERE term NOT IN (SELECT term FROM d)")
def except_terms(documents, benchmark):
    terms = lambda d: d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1)).alias("term")).distinct()
    return terms(benchmark).join(terms(documents.filter("source = 'src1'")), "term", "left_anti")


@query("set6_arms", "bars", sql=f"WITH {CUT}, d AS (SELECT ticker, max(date) < (SELECT max(date) FROM cut) - 14 AS gone FROM cut GROUP BY ticker), x AS (SELECT c.ticker, c.date, lead(close, 21) OVER (PARTITION BY c.ticker ORDER BY c.date) / close - 1 AS r, gone FROM cut AS c JOIN d ON d.ticker = c.ticker) SELECT round(avg(r), 6) AS mean_all, round(avg(r) FILTER (NOT gone), 6) AS mean_survivors, round(100 * (avg(r) FILTER (NOT gone) - avg(r)), 4) AS difference_pp FROM x")
def arms(bars):
    cut = outcomes.cut_archive(bars)
    x = cut.withColumn("r", F.lead("close", 21).over(W()) / F.col("close") - 1).join(outcomes.delisted(cut, 14).select("ticker", "delisted"), "ticker")
    kept = F.avg(F.when(~F.col("delisted"), F.col("r")))
    return x.agg(r6(F.avg("r")).alias("mean_all"), r6(kept).alias("mean_survivors"), F.round(100 * (kept - F.avg("r")), 4).alias("difference_pp"))
