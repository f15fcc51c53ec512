"""Literal frames: one small table for each rule that is easy to get wrong."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapelab.operators import facts, features, outcomes, stats, texts
from tapelab.operators import walkforward as wf
from tapelab.operators.asof import asof_join
from tapelab.operators.events import event_to_bar

D = dt.date


def bars(spark, closes, ticker=1, start=D(2020, 1, 1)):
    rows = [(ticker, start + dt.timedelta(days=i), float(c), float(c), float(c), float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker long, date date, open double, high double, low double, close double, volume double")


def fact_rows(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "ticker long, start_date date, end_date date, val long, filed date")


def test_fourth_quarter_by_subtraction_and_earliest_filing(spark):
    q = [(D(2022, 1, 1), D(2022, 3, 31), 10, D(2022, 5, 1)), (D(2022, 4, 1), D(2022, 6, 30), 20, D(2022, 8, 1)), (D(2022, 7, 1), D(2022, 9, 30), 30, D(2022, 11, 1))]
    restated = (D(2022, 1, 1), D(2022, 3, 31), 12, D(2023, 5, 1))
    year = (D(2022, 1, 1), D(2022, 12, 31), 100, D(2023, 2, 1))
    got = facts.discrete_quarters(fact_rows(spark, [*q, restated, year])).orderBy("end_date").collect()
    assert [r["val"] for r in got] == [10, 20, 30, 40]


def test_cumulative_differences(spark):
    s = D(2022, 1, 1)
    rows = [(s, D(2022, 3, 31), 100, s), (s, D(2022, 6, 30), 250, s), (s, D(2022, 9, 30), 420, s), (s, D(2022, 12, 31), 620, s)]
    got = facts.difference_cumulative(fact_rows(spark, rows)).orderBy("end_date").collect()
    assert [r["val"] for r in got] == [100, 150, 170, 200]


def quarters(spark, rows):
    return spark.createDataFrame([(1, D(2015 + i // 4, 3 * (i % 4) + 1, 28), *r) for i, r in enumerate(rows)], "ticker long, end_date date, revenue long, net_income long, operating_cf long, capex long")


def test_stage_ladder(spark):
    got = facts.with_stage(quarters(spark, [(0, None, None, 0), (10, -5, None, 0), (10, 5, -1, 0), (10, 5, 1, 0)])).orderBy("end_date").collect()
    assert [r["stage"] for r in got] == [0, 1, 2, 3]


def test_crossing_after_losses_and_blip_rejected(spark):
    loss, good = (10, -5, -5, 0), (10, 5, 5, 0)
    got = facts.crossing(facts.with_stage(quarters(spark, [loss] * 8 + [good] * 6))).collect()
    assert [r["crossing"] for r in got] == [D(2017, 1, 28)]
    assert facts.crossing(facts.with_stage(quarters(spark, [loss] * 8 + [good] + [loss] * 5))).count() == 0
    assert facts.crossing(facts.with_stage(quarters(spark, [good] * 14))).count() == 0


def test_failure_ratio(spark):
    got = facts.failures(facts.with_stage(quarters(spark, [(0, -90, -1, 0)] * 16 + [(5, -1, -1, 0)]))).collect()
    assert len(got) == 1 and got[0]["ratio"] < 0.01


def test_ramp_is_about_six_times(spark):
    ramp = [10.0] * 50 + [10 * 6 ** (i / 200) for i in range(1, 201)]
    r = outcomes.best_run(bars(spark, ramp), 210, 5, 1.0).first()
    assert 5.9 < r["multiple"] < 6.1


def test_splice_makes_a_segment_and_spike_is_smoothed(spark):
    s = features.segments(bars(spark, [0.12] * 10 + [31.0] * 10), 10)
    assert [r["segment"] for r in s.orderBy("date").collect()] == [0] * 10 + [1] * 10
    x = features.smooth(features.segments(bars(spark, [1, 1, 1, 8, 1, 1]), 10), 5).orderBy("date").collect()
    assert max(r["smoothed"] for r in x) == 1.0


def barrier(spark, rows):
    b = spark.createDataFrame([(1, D(2020, 1, 1) + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)], "ticker long, date date, open double, high double, low double, close double")
    picks = spark.createDataFrame([(1, 1, 100.0)], "ticker long, entry long, base double")
    return outcomes.barrier_outcome(picks, b, 0.5, 0.2, 3).first()


def test_barrier_stop_first_gap_and_timeout(spark):
    first = (100, 100, 100, 100)
    both = barrier(spark, [first, (100, 160, 70, 100)])
    assert (both["outcome"], round(both["ret"], 9)) == ("stop", -0.2)
    gap = barrier(spark, [first, (60, 65, 55, 60)])
    assert (gap["outcome"], round(gap["ret"], 9)) == ("stop", -0.4)
    late = barrier(spark, [first] * 4)
    assert (late["outcome"], late["held"]) == ("timeout", 3)
    assert barrier(spark, [first] * 2)["outcome"] == "short"


def test_asof_ties_and_strict(spark):
    a = spark.createDataFrame([(1, 10), (1, 20)], "k long, t long")
    b = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 30, 3)], "k long, u long, v long")
    pick = lambda **kw: [r["match"]["v"] if r["match"] else None for r in asof_join(a, b, "k", "t", "u", tie="v", **kw).orderBy("t").collect()]
    assert pick() == [2, 2]
    assert pick(inclusive=False) == [None, 2]
    assert pick(direction="forward") == [1, 3]
    assert pick(direction="forward", inclusive=False) == [3, 3]


def test_event_shift(spark):
    b = spark.createDataFrame([(1, D(2020, 1, 2), 1), (1, D(2020, 1, 6), 2), (1, D(2020, 1, 7), 3)], "ticker long, date date, nth int")
    e = spark.createDataFrame([(1, D(2020, 1, 2), "AMC"), (1, D(2020, 1, 4), "AMC"), (1, D(2020, 1, 6), "BMO"), (1, D(2021, 1, 1), "BMO")], "ticker long, earnings_date date, report_time string")
    pick = lambda **kw: [r["reaction"] for r in event_to_bar(e, b, **kw).orderBy("earnings_date").collect()]
    assert pick() == [2, 2, 2, None]
    assert pick(shift_rolled=True) == [2, 3, 2, None]


def test_drawdown_starts_at_first_equity(spark):
    t = spark.createDataFrame([(1, 1, -0.1), (1, 2, 0.05)], "w long, i long, ret double")
    assert wf.equity_curve(t, ["w"], ["i"]).agg(F.min("drawdown")).first()[0] == 0.0


def test_net_equity_closed_form(spark):
    t = spark.createDataFrame([(1, i, r) for i, r in enumerate((0.1, -0.2, 0.05))], "w long, i long, ret double")
    want, c = [], 10_000.0
    for r in (0.1, -0.2, 0.05):
        c = c * (1 + r) - 1
        want.append(round(c, 6))
    assert [round(r["net_equity"], 6) for r in wf.net_equity(t, ["w"], ["i"], 10_000, 1).orderBy("i").collect()] == want


def test_windows_stop_at_the_end(spark):
    w = wf.windows(spark, "2020-01-01", "2021-01-01", 3, 1, 2).orderBy("window_id").collect()
    assert len(w) == 9 and all(r["predict_end"] <= D(2021, 1, 1) and r["train_end"] < r["predict_start"] for r in w)
    assert wf.windows(spark, "2020-01-01", "2020-02-01", 3, 1, 2).count() == 0


def test_features_do_not_see_the_future(spark):
    b = bars(spark, [10 + (i * 7) % 5 for i in range(60)])
    cut = b.filter(F.col("date") <= F.lit(D(2020, 2, 10)))
    cols = lambda df: features.with_basics(df).select("date", features.rsi("change", 14).alias("a"), features.drawdown(20).alias("b"), features.zscore("volume", 20).alias("c"))
    late = {r["date"]: r for r in cols(b).collect()}
    assert all(late[r["date"]] == r for r in cols(cut).collect())


def test_p_value(spark):
    d = spark.createDataFrame([(0.632, 10), (0.0, 10), (1.0, 10), (0.5, 2)], "r double, n long").coalesce(1)
    p = [x[0] for x in d.select(stats.p_value(F.col("r"), F.col("n"))).collect()]
    assert abs(p[0] - 0.05) < 0.001 and abs(p[1] - 1) < 1e-9 and p[2] == 0.0 and p[3] is None


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"a": [5.0], "b": [1.0, 2.0], "hot": [0.0] * 400 + rng.normal(size=701).tolist(), "wide": (rng.normal(size=999) * 10.0 ** rng.integers(-9, 9, 999)).tolist(), "none": [None, None]}
    d = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double").repartition(4)
    got = {r["g"]: r for r in stats.quantiles(d, "v", ["g"], buckets=16, p0=0.0, p25=0.25, p50=0.5, p975=0.975, p100=1.0).collect()}
    assert got.keys() == {"a", "b", "hot", "wide"}
    for g, r in got.items():
        want = np.quantile(groups[g], [0, 0.25, 0.5, 0.975, 1])
        assert np.allclose([r[c] for c in ("p0", "p25", "p50", "p975", "p100")], want, rtol=1e-12, atol=1e-15)
    upper = {r["g"]: r["m"] for r in stats.quantiles(d, "v", ["g"], upper=True, m=0.5).collect()}
    assert upper == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items() if g != "none"}
    plan = stats.quantiles(d, "v", ["g"], m=0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan.replace("percentile_approx(", "")
    assert stats.quantiles(d.limit(0), "v", [], m=0.5).collect()[0:1] in ([], [(None,)])


def test_draws_add_up(spark):
    c = spark.createDataFrame([(3 * i,) for i in range(37)], "t long")
    w = stats.cluster_draws(c, "t", 20).groupBy("draw").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    assert len(w) == 20 and all(r["w"] == 37 and r["n"] < 37 for r in w)


def test_outlier_flags(spark):
    from tapelab.plans.statistics import outlier_flag

    rows = [(0.1, 0.5, 0.5, 0.1, "no signal"), (0.3, 0.5, 0.5, 0.29, ""), (0.5, 0.01, 0.2, 0.5, "OUTLIER-DRIVEN"), (0.5, 0.01, 0.01, 0.2, "OUTLIER-DRIVEN"), (0.5, 0.01, 0.01, -0.4, "OUTLIER-DRIVEN"), (0.5, 0.01, 0.01, 0.4, ""), (0.5, 0.01, 0.01, None, ""), (0.5, 0.01, 0.01, float("nan"), "")]
    d = spark.createDataFrame(rows, "r double, p double, rank_p double, r4 double, want string")
    assert all(x["flag"] == x["want"] for x in d.withColumn("flag", outlier_flag(F.col("r"), F.col("p"), F.col("rank_p"), F.col("r4"))).collect())


def test_draws_are_dealt_to_tasks(spark):
    """A few thousand clusters are one small partition, and their draws would be one task."""
    c = spark.range(2000).select((F.col("id") * 3).alias("__i"))
    got = stats._drawn(stats._numbered(c.withColumnRenamed("__i", "t"), "t"), 10)
    tasks = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in tasks) == 20_000 and len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in tasks) < 4_000


def frames(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_forward_asof_reads_no_frame_again(spark):
    """A frame from a row to its key's end is read again for each row, which is quadratic in a key's rows."""
    from tapelab.plans.registry import joins

    a = spark.createDataFrame([(1, t) for t in (None, *range(0, 40, 3))] + [(2, 5), (None, 4)], "k long, t long")
    b = spark.createDataFrame([(1, u, 100 * u + v) for u in range(1, 36, 5) for v in range(2)] + [(2, 4, 9), (None, 6, 8)], "k long, u long, v long")
    for strict in (False, True):
        j = asof_join(a, b, "k", "t", "u", "forward", not strict, tie="v")
        assert "unboundedfollowing" not in frames(j)
        for r in j.filter("k = 1 and t is not null").collect():
            later = [100 * u for u in range(1, 36, 5) if u > r["t"] or (u == r["t"] and not strict)]
            assert (r["match"]["v"] if r["match"] else None) == (min(later) if later else None)
    raw = joins.unadjust(spark.createDataFrame([(1, D(2020, 1, d), 1.0) for d in (1, 2, 3)], "ticker long, date date, close double"), spark.createDataFrame([(1, D(2020, 1, 2), 2.0), (1, D(2020, 1, 3), 3.0)], "ticker long, split_date date, ratio double"))
    assert "unboundedfollowing" not in frames(raw)
    assert [r["raw_close"] for r in raw.orderBy("date").collect()] == [6.0, 3.0, 1.0]


def test_event_takes_the_next_bar_without_reading_again(spark):
    b = spark.createDataFrame([(t, D(2020, 1, d), d) for t in (1, 2) for d in range(2, 30, 4)], "ticker long, date date, nth int")
    e = spark.createDataFrame([(t, D(2020, 1, d), "BMO") for t in (1, 2) for d in range(1, 31)], "ticker long, earnings_date date, report_time string")
    t = event_to_bar(e, b)
    assert "unboundedfollowing" not in frames(t)
    for r in t.collect():
        later = [d for d in range(2, 30, 4) if d >= r["earnings_date"].day]
        assert r["at"] == r["reaction"] == (min(later) if later else None)
        assert r["exact"] == (r["earnings_date"].day in later if later else None)


def test_fits_read_stored_rows(spark):
    """A fit goes through its rows many times, so what derives them must not run again each time."""
    from tapelab.operators import models

    rows = spark.createDataFrame([(1, D(1995, 1, 1) + dt.timedelta(days=d), d % 2) for d in range(0, 800, 5)], "ticker long, date date, label int")
    derived = rows.withColumn("nth", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    train, test = models.before(derived, 1996)
    assert "window" not in frames(train) + frames(test)
    assert (train.count(), test.count()) == (53, 87)
    assert train.agg(F.max("date")).first()[0] == D(1995, 9, 18) and test.agg(F.min("nth")).first()[0] == 74


def test_barrier_paths_are_met_once(spark):
    """A pick meets one row of blocks, so what it met isn't gathered again; the trades are stored before their statistics."""
    from tapelab.plans.registry import aggregates

    b = bars(spark, [100, 101, 99, 120, 80, 100])
    picks = spark.createDataFrame([(1, 1, 100.0), (1, 1, 100.0), (1, 4, 120.0), (1, 6, 100.0), (1, -3, 100.0)], "ticker long, entry long, base double")
    t = outcomes.barrier_outcome(picks, b, 0.15, 0.1, 4, block=2)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert sorted((r["entry"], r["outcome"], r["held"]) for r in t.collect()) == [(-3, "timeout", 4), (1, "target", 3), (4, "stop", 1)]
    assert "logicalrdd" not in frames(aggregates.trade_stats(b))
