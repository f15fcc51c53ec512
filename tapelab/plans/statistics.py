"""Statistics and robustness (STA) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import stats as t
from tapelab.operators.windows import r6
from tapelab.plans.registry import query

LONG = """x AS (SELECT ticker, date, xname, x, yname, y FROM scored, LATERAL (VALUES ('ret_21', ret_21), ('drawdown', drawdown), ('score', score)) AS a(xname, x), LATERAL (VALUES ('fwd_ret', fwd_ret), ('fwd_multiple', fwd_multiple)) AS b(yname, y) WHERE x IS NOT NULL AND y IS NOT NULL)"""
RANKS = "rk AS (SELECT xname, yname, ticker, date, x, y, rank() OVER (PARTITION BY xname, yname ORDER BY x) + (count(*) OVER (PARTITION BY xname, yname, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY xname, yname ORDER BY y) + (count(*) OVER (PARTITION BY xname, yname, y) - 1) / 2.0::DOUBLE AS ry FROM x)"
XS, YS = ("ret_21", "drawdown", "score"), ("fwd_ret", "fwd_multiple")


@query("sta1_corr_grid", "scored", sql=f"WITH {LONG} SELECT xname, yname, count(*) AS n, round(corr(x, y), 6) AS pearson FROM x GROUP BY 1, 2 HAVING count(*) >= 5")
def corr_grid(scored):
    return t.pairs(scored, XS, YS).groupBy("xname", "yname").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("x", "y")).alias("pearson")).filter("n >= 5")


@query("sta2_spearman_grid", "scored", sql=f"WITH {LONG.replace("yname, y FROM", "yname, round(y, 9) AS y FROM").replace("xname, x,", "xname, round(x, 9) AS x,")}, {RANKS} SELECT xname, yname, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM rk GROUP BY 1, 2 HAVING count(*) >= 5")
def spearman_grid(scored):
    p = t.pairs(scored, XS, YS).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})  # so that ties don't hang on the last bit
    return t.spearman(p, ["xname", "yname"]).select("xname", "yname", "n", r6("rho").alias("spearman")).filter("n >= 5")


@query("sta3_p_values", "scored")
def p_values(scored):
    """Two-sided p of each correlation, and its mark. The grid is a few rows; the tail needs the incomplete beta."""
    g = t.pairs(scored, XS, YS).groupBy("xname", "yname").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    p = t.p_value(F.col("r"), F.col("n"))
    return g.select("xname", "yname", "n", r6("r").alias("pearson"), p.alias("p")).withColumn("mark", F.when(F.col("p") < 0.05, "**").when(F.col("p") < 0.10, "*").otherwise(""))


@query("sta4_robustness", "scored", sql=f"WITH {LONG}, d AS (SELECT *, row_number() OVER (PARTITION BY xname, yname ORDER BY y DESC, ticker, date) AS k FROM x) SELECT xname, yname, round(corr(x, y), 6) AS r, round(corr(x, y) FILTER (k > 4), 6) AS r_drop_4, CASE WHEN sign(corr(x, y)) <> sign(corr(x, y) FILTER (k > 4)) OR abs(corr(x, y) FILTER (k > 4)) < abs(corr(x, y)) / 2 THEN 'OUTLIER-DRIVEN' ELSE '' END AS flag FROM d GROUP BY 1, 2 HAVING count(*) >= 10")
def robustness(scored):
    g = _robust(scored)
    flag = F.when((F.signum("r") != F.signum("r4")) | (F.abs("r4") < F.abs("r") / 2), "OUTLIER-DRIVEN").otherwise("")
    return g.select("xname", "yname", r6("r").alias("r"), r6("r4").alias("r_drop_4"), flag.alias("flag"))


def _robust(scored):
    """xname, yname, n, r, r4: correlations of at least ten pairs, with and without the four largest outcomes."""
    p = t.pairs(scored, XS, YS)
    key = ["xname", "yname", "ticker", "date"]
    first = p.withColumn("k", F.row_number().over(Window.partitionBy("xname", "yname").orderBy(F.desc("y"), "ticker", "date"))).filter("k <= 4")
    d = p.join(F.broadcast(first.select(*key, "k")), key, "left")  # four rows a pair of names
    tail = lambda c: F.when(F.col("k").isNull(), F.col(c))
    r, r4 = F.corr("x", "y"), F.corr(tail("x"), tail("y"))
    return d.groupBy("xname", "yname").agg(r.alias("r"), r4.alias("r4"), F.count(F.lit(1)).alias("n")).filter("n >= 10")


def outlier_flag(r, p, rank_p, r4):
    """no signal: neither a small p nor a large r; OUTLIER-DRIVEN: only the values correlate, not their ranks, or a few large outcomes make it; else blank."""
    few = r4.isNotNull() & ~F.isnan(r4) & ((F.signum(r4) != F.signum(r)) | (F.abs(r4) < 0.5 * F.abs(r)))
    return F.when((p >= 0.1) & (F.abs(r) < 0.25), "no signal").when(((p < 0.05) & (rank_p >= 0.05)) | few, "OUTLIER-DRIVEN").otherwise("")


@query("sta4_flags", "scored")
def robustness_flags(scored):
    """Each score with each outcome: both correlations with their p, the one without the four largest outcomes, and what to think of it."""
    rho = t.spearman(t.pairs(scored, XS, YS), ["xname", "yname"]).drop("n")
    g = _robust(scored).join(rho, ["xname", "yname"]).withColumns({"p": t.p_value(F.col("r"), F.col("n")), "rank_p": t.p_value(F.col("rho"), F.col("n"))})
    return g.select("xname", "yname", "n", r6("r").alias("r"), F.col("p"), r6("rho").alias("rho"), F.col("rank_p"), r6("r4").alias("r_drop_4"), outlier_flag(F.col("r"), F.col("p"), F.col("rank_p"), F.col("r4")).alias("flag"))


@query("sta5_best_vs_baseline", "scored", sql=f"WITH {LONG}, g AS (SELECT xname, yname, corr(x, y) AS r FROM x GROUP BY 1, 2 HAVING count(*) >= 10) SELECT yname, max_by(xname, abs(r)) FILTER (xname <> 'score') AS best, round(max_by(r, abs(r)) FILTER (xname <> 'score'), 6) AS best_r, round(max(r) FILTER (xname = 'score'), 6) AS baseline_r FROM g GROUP BY yname")
def best_vs_baseline(scored):
    g = t.pairs(scored, XS, YS).groupBy("xname", "yname").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 10")
    other = F.when(F.col("xname") != "score", F.abs("r"))
    return g.groupBy("yname").agg(F.max_by("xname", other).alias("best"), r6(F.max_by("r", other)).alias("best_r"), r6(F.max(F.when(F.col("xname") == "score", F.col("r")))).alias("baseline_r"))


@query("sta6_lift", "scored", sql="WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ticker, date) AS r, count(*) OVER () AS n, avg(label) OVER () AS base FROM scored) SELECT round(avg(label), 6) AS precision_, round(max(base), 6) AS base_rate, round(avg(label) / nullif(max(base), 0), 6) AS lift FROM r WHERE r <= greatest(1, floor(n * 2 / 100))")
def lift(scored):
    return t.lift(scored, "score", "label", 2).select(r6("precision_").alias("precision_"), r6("base_rate").alias("base_rate"), r6("lift").alias("lift"))


AUC = "SELECT {k} round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6) AS auc FROM (SELECT *, rank() OVER ({p} ORDER BY score) + (count(*) OVER (PARTITION BY {q} score) - 1) / 2.0::DOUBLE AS rk FROM scored) AS x {g}"


@query("sta7_auc", "scored", sql=AUC.format(k="year,", p="PARTITION BY year", q="year,", g="GROUP BY year"))
def auc(scored):
    return t.auc(scored, "score", "label", ["year"]).select("year", r6("auc").alias("auc"))


DRAWS = 500
_BOOT = f"""c AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) AS n, sum(score) AS sx, sum(fwd_ret) AS sy, sum(score * score) AS sxx, sum(fwd_ret * fwd_ret) AS syy, sum(score * fwd_ret) AS sxy FROM scored WHERE score IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY ticker),
    d AS (SELECT draw, CAST('0x' || substr(md5(draw || '-' || i), 1, 8) AS BIGINT) % (SELECT count(*) FROM c) AS i FROM c CROSS JOIN (SELECT unnest(generate_series(1, {DRAWS})) AS draw) AS g),
    w AS (SELECT draw, sum(c.n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM d JOIN c ON c.i = d.i GROUP BY draw),
    r AS (SELECT (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM w)"""


@query("sta8_bootstrap_ci", "scored", sql=f"WITH {_BOOT} SELECT count(r) AS draws, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r WHERE NOT isnan(r)")
def bootstrap_ci(scored):
    """Cluster bootstrap by ticker: in each draw as many tickers as there are, with replacement, by a hash that any engine has."""
    return t.bootstrap_corr(scored, "ticker", "score", "fwd_ret", DRAWS).select("draws", r6("low").alias("low"), r6("high").alias("high"))


_TOP4 = "k AS (SELECT score, fwd_ret, row_number() OVER (ORDER BY fwd_ret DESC, ticker, date) AS k FROM scored WHERE score IS NOT NULL AND fwd_ret IS NOT NULL)"


def _validated(scored):
    """n, r, r without the four largest outcomes of all, low, high. The four are found by a top-k, and left out by their keys."""
    ci = t.bootstrap_corr(scored, "ticker", "score", "fwd_ret", DRAWS)
    d = scored.filter("score is not null and fwd_ret is not null").select("ticker", "date", "score", "fwd_ret")
    four = d.orderBy(F.desc("fwd_ret"), "ticker", "date").limit(4).select("ticker", "date", F.lit(True).alias("largest"))
    d = d.join(F.broadcast(four), ["ticker", "date"], "left")
    rest = lambda c: F.when(F.col("largest").isNull(), F.col(c))
    return d.agg(F.count(F.lit(1)).alias("n"), F.corr("score", "fwd_ret").alias("r"), F.corr(rest("score"), rest("fwd_ret")).alias("r4")).join(F.broadcast(ci))  # one row each


@query("sta9_drop_top", "scored", sql=f"WITH {_BOOT}, {_TOP4} SELECT (SELECT count(*) FROM k) AS n, round((SELECT corr(score, fwd_ret) FROM k), 6) AS r, round((SELECT corr(score, fwd_ret) FROM k WHERE k > 4), 6) AS r_drop_4, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r WHERE NOT isnan(r)")
def drop_top(scored):
    return _validated(scored).select("n", r6("r").alias("r"), r6("r4").alias("r_drop_4"), r6("low").alias("low"), r6("high").alias("high"))


@query("sta9_validate_scores", "scored")
def validate(scored):
    x = _validated(scored).withColumn("p", t.p_value(F.col("r"), F.col("n")))
    flag = F.when(F.col("p") >= 0.1, "no signal").when(((F.col("low") > 0) | (F.col("high") < 0)) & (F.signum("r") == F.signum("r4")), "survives").otherwise("fragile")
    return x.select("n", r6("r").alias("r"), r6("r4").alias("r_drop_4"), r6("low").alias("low"), r6("high").alias("high"), flag.alias("flag"))


@query("sta11_clf_metrics", "scored", sql="WITH m AS (SELECT year, count(*) AS n, count(*) FILTER (score > 0.05 AND label = 1) AS tp, count(*) FILTER (score > 0.05 AND label = 0) AS fp, count(*) FILTER (score <= 0.05 AND label = 1) AS fn, count(*) FILTER ((score > 0.05) = (label = 1)) AS hit FROM scored GROUP BY year) SELECT year, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(hit / n, 6) AS accuracy FROM m")
def metrics(scored):
    return t.classification(scored.withColumn("predicted", (F.col("score") > 0.05).cast("int")), "predicted", "label", ["year"]).select("year", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"))


@query("sta12_survivorship_bias", "scored", sql="WITH d AS (SELECT *, ticker % 8 = 7 AS gone FROM scored), a AS (SELECT 'survivors' AS arm, fwd_ret FROM d WHERE NOT gone UNION ALL SELECT 'full', fwd_ret FROM d UNION ALL SELECT 'haircut', CASE WHEN gone THEN (1 + fwd_ret) * 0.5 - 1 ELSE fwd_ret END FROM d), m AS (SELECT arm, avg(fwd_ret) AS m, count(*) AS n FROM a GROUP BY arm) SELECT arm, n, round(m, 6) AS mean_ret, round(100 * ((SELECT m FROM m WHERE arm = 'survivors') - m), 4) AS bias_pp FROM m")
def survivorship(scored):
    gone = F.col("ticker") % 8 == 7
    arms = F.array(F.struct(F.lit("full").alias("arm"), F.col("fwd_ret").alias("r")), F.struct(F.lit("haircut").alias("arm"), F.when(gone, (1 + F.col("fwd_ret")) * 0.5 - 1).otherwise(F.col("fwd_ret")).alias("r")), F.when(~gone, F.struct(F.lit("survivors").alias("arm"), F.col("fwd_ret").alias("r"))))
    m = scored.select(F.inline(F.array_compact(arms))).groupBy("arm").agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("n"))
    base = m.filter("arm = 'survivors'").select(F.col("m").alias("s"))
    return m.join(F.broadcast(base)).select("arm", "n", r6("m").alias("mean_ret"), F.round(100 * (F.col("s") - F.col("m")), 4).alias("bias_pp"))


@query("sta13_sharpe", "scored", sql="SELECT ticker, round(CASE WHEN count(*) < 2 OR coalesce(stddev_samp(fwd_ret), 0) = 0 THEN 0 ELSE avg(fwd_ret) / stddev_samp(fwd_ret) * sqrt(12) END, 5) AS sharpe FROM scored GROUP BY ticker")
def sharpe(scored):
    return scored.groupBy("ticker").agg(F.round(t.sharpe("fwd_ret", 12), 5).alias("sharpe"))


@query("sta10_permutation_importance", "scored")
def importance(scored):
    from tapelab.operators.models import permutation_importance

    return permutation_importance(scored, "logistic")
