"""Walk-forward evaluation (MOD), run diagnosis (AGG10) and streaming twins (STR) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import stats
from tapelab.operators import walkforward as wf
from tapelab.operators.windows import r6
from tapelab.plans import sqltext as s
from tapelab.plans.registry import query

SPAN = ("1992-06-01", "1998-06-01", 12, 4, 5)
WINS_SQL = "wins AS (SELECT CAST(k AS INTEGER) AS window_id, CAST(DATE '1992-06-01' + CAST(k * 120 AS INTEGER) AS DATE) AS train_start, CAST(DATE '1992-06-01' + CAST(k * 120 + 360 AS INTEGER) AS DATE) AS train_end, CAST(DATE '1992-06-01' + CAST(k * 120 + 365 AS INTEGER) AS DATE) AS predict_start, CAST(DATE '1992-06-01' + CAST(k * 120 + 485 AS INTEGER) AS DATE) AS predict_end FROM (SELECT unnest(generate_series(0, 20)) AS k) AS g WHERE DATE '1992-06-01' + CAST(k * 120 + 485 AS INTEGER) <= DATE '1998-06-01')"
TRADES_SQL = f"{WINS_SQL}, tr AS (SELECT w.window_id, s.ticker, s.date, s.fwd_ret, s.label, s.score, CASE WHEN s.score > 0.05 THEN 1 ELSE 0 END AS pos, CASE WHEN s.score > 0.05 THEN s.fwd_ret / 10 ELSE 0 END AS ret FROM scored AS s JOIN wins AS w ON s.date >= w.predict_start AND s.date < w.predict_end)"
BY = "(PARTITION BY window_id ORDER BY date, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
RESULT_SQL = f"eq AS (SELECT *, product(1 + ret) OVER {BY} AS equity FROM tr), dd AS (SELECT *, equity / max(equity) OVER {BY} - 1 AS drawdown FROM eq), res AS (SELECT window_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS num_trades, max_by(equity, (date, ticker)) - 1 AS roi, min(drawdown) AS max_drawdown, coalesce(2.0 * count(*) FILTER (pos = 1 AND label = 1) / nullif(2 * count(*) FILTER (pos = 1 AND label = 1) + count(*) FILTER (pos = 1 AND label = 0) + count(*) FILTER (pos = 0 AND label = 1), 0), 0) AS f1, avg(CASE WHEN pos = label THEN 1 ELSE 0 END) AS accuracy FROM dd GROUP BY window_id)"


def trades(scored):
    t = wf.assign(scored, wf.windows(scored.sparkSession, *SPAN)).filter("role = 'predict'")
    pos = (F.col("score") > 0.05).cast("int")
    return t.select("window_id", "ticker", "date", "fwd_ret", "label", "score", pos.alias("pos"), F.when(pos == 1, F.col("fwd_ret") / 10).otherwise(0.0).alias("ret"))


def results(scored):
    """window_id, n, num_trades, roi, max_drawdown, f1, accuracy."""
    t = trades(scored)
    c = wf.equity_curve(t, ["window_id"], ["date", "ticker"]).groupBy("window_id").agg(F.sum("pos").alias("num_trades"), (F.max_by("equity", F.struct("date", "ticker")) - 1).alias("roi"), F.min("drawdown").alias("max_drawdown"))
    return c.join(stats.classification(t, "pos", "label", ["window_id"]), "window_id")


@query("mod2_wf_range", "bars", sql="WITH t AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY ticker) SELECT max(a) AS start_date, min(b) - 180 AS end_date FROM t")
def wf_range(bars):
    t = bars.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return t.agg(F.max("a").alias("start_date"), F.date_sub(F.min("b"), 180).alias("end_date"))


@query("mod1_wf_windows", "bars", sql="WITH t AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY ticker), r AS (SELECT max(a) AS s, min(b) - 180 AS e FROM t), g AS (SELECT s, e, unnest(generate_series(0, (e - s) // 120)) AS k FROM r) SELECT CAST(k AS INTEGER) AS window_id, CAST(s + CAST(k * 120 AS INTEGER) AS DATE) AS train_start, CAST(s + CAST(k * 120 + 360 AS INTEGER) AS DATE) AS train_end, CAST(s + CAST(k * 120 + 365 AS INTEGER) AS DATE) AS predict_start, CAST(s + CAST(k * 120 + 485 AS INTEGER) AS DATE) AS predict_end FROM g WHERE s + CAST(k * 120 + 485 AS INTEGER) <= e")
def wf_windows(bars):
    """Windows over the range that all tickers share."""
    return wf.windows_of(wf_range(bars), *SPAN[2:])



@query("mod4_events_in_window", "earnings", sql=f"WITH {WINS_SQL}, d AS (SELECT *, surprise_pct - lag(surprise_pct) OVER (PARTITION BY ticker ORDER BY earnings_date, eps_reported) AS delta FROM earnings) SELECT window_id, CASE WHEN earnings_date < train_end THEN 'train' ELSE 'predict' END AS role, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM d JOIN wins ON (earnings_date >= train_start AND earnings_date < train_end) OR (earnings_date >= predict_start AND earnings_date < predict_end) GROUP BY 1, 2")
def events_in_window(earnings):
    """Features first (they are local to the event), then sliced."""
    d = earnings.withColumn("delta", F.col("surprise_pct") - F.lag("surprise_pct").over(Window.partitionBy("ticker").orderBy("earnings_date", "eps_reported")))
    return wf.assign(d, wf.windows(earnings.sparkSession, *SPAN), "earnings_date").groupBy("window_id", "role").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta")).alias("mean_delta"))


@query("mod5_usable_windows", "scored", sql=f"WITH {WINS_SQL}, x AS (SELECT window_id, CASE WHEN date < train_end THEN 'train' ELSE 'predict' END AS role, label FROM scored JOIN wins ON (date >= train_start AND date < train_end) OR (date >= predict_start AND date < predict_end)) SELECT window_id, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'predict') AS predict_rows FROM x GROUP BY window_id HAVING count(*) FILTER (role = 'train') >= 30 AND count(*) FILTER (role = 'predict') >= 5 AND count(DISTINCT label) FILTER (role = 'train') = 2")
def usable(scored):
    x = wf.assign(scored, wf.windows(scored.sparkSession, *SPAN))
    train = F.col("role") == "train"
    g = x.groupBy("window_id").agg(F.count_if(train).alias("train_rows"), F.count_if(~train).alias("predict_rows"), F.countDistinct(F.when(train, F.col("label"))).alias("classes"))
    return g.filter("train_rows >= 30 and predict_rows >= 5 and classes = 2").drop("classes")


@query("mod6_fit_logistic", "scored")
def logistic(scored):
    from tapelab.operators.models import fit_predict

    return fit_predict(scored, "logistic")


@query("mod7_fit_forest", "scored")
def forest(scored):
    from tapelab.operators.models import fit_predict

    return fit_predict(scored, "forest")


@query("mod8_fit_gbt", "scored")
def boosted(scored):
    from tapelab.operators.models import fit_predict

    return fit_predict(scored, "gbt")


@query("mod9_calibrate", "scored", sql="WITH tr AS (SELECT * FROM scored WHERE year < 1996), e AS (SELECT list_distinct(quantile_cont(score, [0.2, 0.4, 0.6, 0.8])) AS edges FROM tr), e2 AS (SELECT CASE WHEN len(edges) < 3 THEN [] ELSE edges END AS edges FROM e), b AS (SELECT len(list_filter(edges, lambda v: v < score)) AS bin, avg(label) AS rate FROM tr CROSS JOIN e2 GROUP BY 1) SELECT s.ticker, s.date, CAST(b.bin AS INTEGER) AS bin, round(rate, 6) AS rate, round(least(greatest(2 * (rate - 0.5), 0), 1), 6) AS size FROM (SELECT s.*, len(list_filter(edges, lambda v: v < score)) AS bin FROM scored AS s CROSS JOIN e2 WHERE year >= 1996) AS s LEFT JOIN b ON b.bin = s.bin")
def calibrate(scored):
    c = wf.calibrate(scored.filter("year < 1996"), scored.filter("year >= 1996"), "score", "label")
    return c.select("ticker", "date", "bin", r6("rate").alias("rate"), r6("size").alias("size"))


@query("mod10_size_positions", "scored", sql="SELECT ticker, date, round(CASE WHEN ret_21 > 0.01 AND ret_21 - drawdown > -0.2 THEN least(greatest(ret_21 / 0.1, 0), 1) ELSE 0 END, 6) AS size FROM scored")
def size_positions(scored):
    ok = (F.col("ret_21") > 0.01) & (F.col("ret_21") - F.col("drawdown") > -0.2)
    return scored.select("ticker", "date", r6(F.when(ok, F.least(F.greatest(F.col("ret_21") / 0.1, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).alias("size"))


@query("mod11_equity_curve", "scored", sql=f"WITH {TRADES_SQL}, {RESULT_SQL} SELECT window_id, ticker, date, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM dd")
def equity(scored):
    c = wf.equity_curve(trades(scored), ["window_id"], ["date", "ticker"])
    return c.select("window_id", "ticker", "date", r6("equity").alias("equity"), r6("drawdown").alias("drawdown"))


@query("mod12_net_equity", "scored", sql=f"WITH RECURSIVE {TRADES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY date, ticker) AS k FROM tr WHERE pos = 1), c AS (SELECT window_id, k, 10000 * (1 + ret) - 1 AS net FROM o WHERE k = 1 UNION ALL SELECT o.window_id, o.k, c.net * (1 + o.ret) - 1 FROM c JOIN o ON o.window_id = c.window_id AND o.k = c.k + 1) SELECT window_id, k, round(net, 4) AS net_equity FROM c")
def net_equity(scored):
    t = trades(scored).filter("pos = 1")
    n = wf.net_equity(t, ["window_id"], ["date", "ticker"], 10_000, 1)
    k = F.row_number().over(Window.partitionBy("window_id").orderBy("date", "ticker")).cast("long")
    return n.select("window_id", k.alias("k"), F.round("net_equity", 4).alias("net_equity"))


@query("mod13_window_results", "scored", sql=f"WITH {TRADES_SQL}, {RESULT_SQL} SELECT window_id, n, num_trades, round(roi, 6) AS roi, round(max_drawdown, 6) AS max_drawdown, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM res")
def window_results(scored):
    r = results(scored)
    return r.select("window_id", "n", "num_trades", *(r6(c).alias(c) for c in ("roi", "max_drawdown", "f1", "accuracy")))


CHAIN = "(ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("mod14_chain", "scored", sql=f"WITH {TRADES_SQL}, {RESULT_SQL}, ch AS (SELECT window_id, product(1 + roi) OVER {CHAIN} AS chained FROM res) SELECT window_id, round(chained, 6) AS chained, round(chained / greatest(1, max(chained) OVER {CHAIN}) - 1, 6) AS chained_drawdown FROM ch")
def chain(scored):
    """One row per window, so the order over all windows is over a few dozen rows; the peak starts at 1."""
    w = Window.partitionBy(F.lit(0)).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    c = results(scored).select("window_id", F.product(1 + F.col("roi")).over(w).alias("chained"))
    return c.select("window_id", r6("chained").alias("chained"), r6(F.col("chained") / F.greatest(F.lit(1.0), F.max("chained").over(w)) - 1).alias("chained_drawdown"))


@query("mod15_leaderboard", "scored", sql=f"WITH {TRADES_SQL}, {RESULT_SQL} SELECT window_id, round(roi, 6) AS roi, coalesce(roi < max(roi) OVER (ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS regressed, roi > 0.05 AS accepted FROM res")
def leaderboard(scored):
    w = Window.partitionBy(F.lit(0)).orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    return results(scored).select("window_id", r6("roi").alias("roi"), F.coalesce(F.col("roi") < F.max("roi").over(w), F.lit(False)).alias("regressed"), (F.col("roi") > 0.05).alias("accepted"))


@query("agg10_diagnose", "scored", sql=f"WITH {TRADES_SQL}, {RESULT_SQL} SELECT count(*) AS windows, round(coalesce(avg(roi), 0), 6) AS mean_roi, round(coalesce(median(roi), 0), 6) AS median_roi, round(coalesce(product(1 + roi) - 1, 0), 6) AS chained_roi, count(*) FILTER (f1 = 0) AS collapsed, round(coalesce(min(max_drawdown), 0), 6) AS worst_drawdown, CAST(coalesce(sum(num_trades), 0) AS BIGINT) AS num_trades FROM res")
def diagnose(scored):
    zero = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    return results(scored).agg(F.count(F.lit(1)).alias("windows"), zero(F.avg("roi")).alias("mean_roi"), zero(F.median("roi")).alias("median_roi"), zero(F.product(1 + F.col("roi")) - 1).alias("chained_roi"), F.count_if(F.col("f1") == 0).alias("collapsed"), zero(F.min("max_drawdown")).alias("worst_drawdown"), F.coalesce(F.sum("num_trades"), F.lit(0)).alias("num_trades"))


@query("mod17_yearly_folds", "scored", sql="WITH y AS (SELECT DISTINCT year AS fold FROM scored), x AS (SELECT fold, count(*) FILTER (date < make_date(fold, 1, 1) - 100) AS train_rows, count(*) FILTER (year = fold) AS test_rows, avg(label) FILTER (year = fold) AS base FROM scored CROSS JOIN y GROUP BY fold) SELECT CAST(fold AS INTEGER) AS fold, train_rows, test_rows, round(base, 6) AS base_rate FROM x WHERE train_rows >= 50 AND test_rows >= 20")
def yearly_folds(scored):
    """Counts per day and per year are joined to the few folds, not the rows."""
    days = scored.groupBy("date", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    folds = days.select(F.col("year").alias("fold")).distinct()
    cut = F.date_sub(F.make_date("fold", F.lit(1), F.lit(1)), 100)
    x = days.join(F.broadcast(folds), (F.col("date") < cut) | (F.col("year") == F.col("fold")))
    test = F.col("year") == F.col("fold")
    g = x.groupBy("fold").agg(F.coalesce(F.sum(F.when(F.col("date") < cut, F.col("n"))), F.lit(0)).alias("train_rows"), F.sum(F.when(test, F.col("n"))).alias("test_rows"), F.sum(F.when(test, F.col("hits"))).alias("hits"))
    return g.filter("train_rows >= 50 and test_rows >= 20").select("fold", "train_rows", "test_rows", r6(F.col("hits") / F.col("test_rows")).alias("base_rate"))


@query("mod16_holdout_tickers", "scored", "sic")
def holdout(scored, sic):
    """A fifth of the tickers, by hash, is never learned from."""
    from tapelab.operators.models import holdout_eval

    return holdout_eval(scored, sic.filter(F.pmod(F.crc32(F.col("ticker").cast("string").cast("binary")), F.lit(5)) == 0), "logistic")
