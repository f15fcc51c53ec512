"""Literal frames for the queries over all rows: each has rows that an id subset would leave out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tapelab.plans.registry  # noqa: F401  (loads the plans in their order)
from tapelab.operators.fresh import fingerprint, fresh_rows
from tapelab.plans import incremental, whole
from tapelab.sources import files

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def closes(spark, tickers, n):
    return spark.createDataFrame([(t, D(1992, 6, 1) + dt.timedelta(days=i), float(t + i)) for t in tickers for i in range(n)], "ticker long, date date, close double")


def test_window_features_of_every_ticker(spark):
    got = {(w, role): n for w, role, n, _ in rows(whole.features_in_window(closes(spark, range(1, 6), 12)), "window_id")}
    assert got == {(0, "train"): 5 * 2}


def test_every_tick_meets_every_article(spark):
    ticks = spark.createDataFrame([(1, 0, 10), (2, 0, 20), (3, 0, 30), (4, 1, 30)], "event_id long, ticker long, us long")
    news = spark.createDataFrame([(0, 15, 4), (0, 20, 5), (0, 20, 7), (0, 40, 6)], "ticker long, us long, article_id long")
    assert rows(whole.asof_backward(ticks, news), "event_id") == [(1, 0, None), (2, 0, 7), (3, 0, 7), (4, 1, None)]


def test_every_bar_and_quarter_with_max_age(spark):
    days = [D(2020, 3, 31), D(2020, 7, 1), D(2020, 10, 8), D(2020, 10, 9)]
    bars = spark.createDataFrame([(1, d) for d in days], "ticker long, date date")
    q = spark.createDataFrame([(1, D(2020, 3, 31), 10), (1, D(2020, 6, 30), 20)], "ticker long, end_date date, revenue long")
    assert [r[2] for r in rows(whole.max_age(bars, q), "date")] == [10, 20, 20, None]


def test_chain_and_pairs_over_a_gap(spark):
    ends = [D(2019, 9, 30), D(2019, 12, 31), D(2020, 3, 31), D(2020, 12, 31), D(2021, 3, 31)]
    q = spark.createDataFrame([(t, d, 10 * i * i) for t in range(6) for i, d in enumerate(ends)], "ticker long, end_date date, revenue long")
    want = [("first", None), ("linked", 0), ("linked", 0), ("break", 2), ("linked", 0)]
    assert [r[2:] for r in rows(whole.chain(q), "ticker", "end_date")] == want * 6
    pairs = [(ends[1], ends[0], 10), (ends[2], ends[1], 30), (ends[4], ends[3], 70)]
    assert [r[1:] for r in rows(whole.adjacent(q), "ticker", "end_date")] == pairs * 6


def test_files_of_every_ticker(spark):
    bars = closes(spark, range(1, 20), 3)
    want = rows(bars, "ticker", "date")
    assert rows(whole.vendor_daily(bars), "ticker", "date") == want
    assert rows(whole.price_cache(bars), "ticker", "date") == want


def test_bars_in_folders_of_many_tickers(spark, tmp_path):
    """Every tick comes back, also those of tickers below zero, of huge ones and of none, and files don't grow with the tickers."""
    tickers = [None, -(2**63), -65, -1, 2**63 - 1, *range(300)]
    ticks = spark.createDataFrame([(t, i, 1_000_000 * i + 7, 1.5 + i) for i, t in enumerate(tickers)], "ticker long, event_id long, us long, price double")
    got = incremental.src1(ticks)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(t, i, 1_000_000 * i + 7, 1.5 + i) for i, t in enumerate(tickers)]
    assert len(got.inputFiles()) <= 2**files.FOLDER_BITS + 1
    ticks.selectExpr("event_id", "us div 1000 AS timestamp", "ticker").filter("ticker < 3").write.partitionBy("ticker").csv(f"{tmp_path}/each", header=True)
    each = files.read_bars(spark, f"{tmp_path}/each", "event_id long, timestamp long")
    assert {(r["event_id"], r["ticker"]) for r in each.collect()} == {(i, t) for i, t in enumerate(tickers) if t is not None and t < 3}


def test_vendor_files_of_many_tickers(spark):
    """The rows of all tickers come back, the bad ones are written and dropped, and files don't grow with the tickers."""
    bars = closes(spark, [-130, -1, 2**40 + 5, *range(300)], 2)
    got = whole.vendor_daily(bars)
    assert rows(got, "ticker", "date") == rows(bars, "ticker", "date")
    assert len(got.inputFiles()) <= 2**files.FOLDER_BITS
    lines = [x for f in got.inputFiles() for x in open(f.removeprefix("file://"), encoding="utf-8").read().splitlines()]
    assert sum(x.startswith("no date,1,") for x in lines) == sum(",n/a," in x for x in lines) == 303


def test_fresh_rows_by_fingerprint(spark):
    old = [(i, f"text {i}") for i in range(20)]
    stored = spark.createDataFrame(old, "doc_id long, text string").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"), (F.col("doc_id") % 2).alias("quality"))
    now = [(i, t + " changed" if i in (3, 8) else t) for i, t in old if i != 5] + [(30, "text 5"), (31, None)]
    current = spark.createDataFrame(now, "doc_id long, text string")
    fresh = [i for i in range(20) if i not in (3, 5, 8)]
    assert rows(fresh_rows(stored, current, "doc_id", "text").select("doc_id", "quality"), "doc_id") == [(i, i % 2) for i in fresh]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality long")
    assert [r[0] for r in rows(whole.fresh(current, labels), "doc_id")] == [i for i in range(20) if i != 5]


def test_every_bar_is_an_entry(spark):
    """Short tickers, and steps that hit the stop, the target or nothing; against plain loops."""
    series = {1: [100.0, 100.0], 2: [100.0, 120.0, 80.0, 81.0, 82.0], 3: [50.0 + 10 * ((i * i) % 7 == 3) + i / 9 for i in range(80)], 7: [100.0] * 70, 9: [5.0]}
    data = [(t, D(1998, 6, 1) + dt.timedelta(days=i), c - 0.5, c + 1, c - 1, c) for t, cs in series.items() for i, c in enumerate(cs)]
    bars = spark.createDataFrame(data, "ticker long, date date, open double, high double, low double, close double")

    def expected(archive, haircut, short):
        out = []
        for t in series:
            b = [r for r in archive if r[0] == t]
            for e in range(len(b) - 1):
                base, path = b[e][5], b[e + 1 : e + 64]
                price, what, held = path[-1][5] * (haircut if len(path) < 63 else 1), short if len(path) < 63 else "timeout", len(path)
                for k, (_, _, open_, high, low, _) in enumerate(path, 1):
                    if low <= base * (1 - 0.1) or high >= base * (1 + 0.15):
                        stop = low <= base * (1 - 0.1)
                        price, what, held = (min(base * (1 - 0.1), open_), "stop", k) if stop else (max(base * (1 + 0.15), open_), "target", k)
                        break
                out.append((t, e + 1, what, price / base - 1, held))
        return out

    got = lambda df: [(*r[:3], pytest.approx(r[3], abs=1e-6), r[4]) for r in rows(df, "ticker", "entry")]
    assert got(whole.barrier(bars)) == expected(data, 1, "short")
    assert got(whole.barrier_delisted(bars)) == expected([r for r in data if r[0] % 8 != 7 or r[1] <= D(1998, 6, 30)], 0.5, "delisted_timeout")
    want = [(t, e + 1, len(cs[e + 1 : e + 31]), round(max(cs[e + 1 : e + 31]) + 1, 6), round(min(cs[e + 1 : e + 31]) - 1, 6)) for t, cs in series.items() for e in range(len(cs) - 1)]
    assert rows(whole.paths(bars), "ticker", "entry") == want


def test_ten_tickers_share_the_articles_of_all_users(spark):
    from tapelab.plans import features, joins

    day = 86_400_000_000
    at = [(1, 3, 0, 1), (2, 13, day - 1, -1), (3, 1003, day - 1, 1), (4, 23, day, 1), (5, 7, day, 0), (6, 33, 5 * day, -1), (7, 3, None, 1), (8, 13, None, 0), (9, None, day, 1)]
    news = spark.createDataFrame(at, "article_id long, ticker long, us long, sentiment int").withColumn("published", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, us / 1000000)"))
    got = {r["article_id"]: (r["ticker"], r["mean_24h"], r["n_24h"]) for r in features.trailing_sentiment(news).collect()}
    assert got == {1: (3, 1.0, 1), 2: (3, 0.333333, 3), 3: (3, 0.333333, 3), 4: (3, 0.333333, 3), 5: (7, 0.0, 1), 6: (3, -1.0, 1), 7: (3, 0.5, 2), 8: (3, 0.5, 2), 9: (None, 1.0, 1)}

    earnings = spark.createDataFrame([(13, dt.date(1995, 1, 1)), (23, dt.date(1995, 1, 1)), (3, dt.date(1995, 1, 31)), (7, dt.date(1995, 2, 1))], "ticker long, earnings_date date")
    got = {(r["ticker"], str(r["earnings_date"])): (r["articles"], r["total"]) for r in joins.lookback(earnings, news).collect()}
    assert got == {(3, "2024-01-01"): (3, 1), (3, "2024-01-31"): (5, 1), (7, "2024-02-01"): (1, 0)}


def test_articles_keep_their_own_ticker(spark):
    """Each article's window over its own ticker stands beside that over all tickers with its last digit; against plain loops."""
    from tapelab.plans import features

    day = 86_400_000_000
    at = [(1, 3, 0, 1), (2, 13, 0, -1), (3, 3, day - 1, -1), (4, 3, day, 0), (5, 3, day, None), (6, 13, day - 1, 1), (7, -7, -1, 1), (8, 3, None, 1), (9, 13, None, 0), (10, None, day, 1), (11, None, day + 1, 0), (12, 1003, 5 * day, None), (12, 1003, 5 * day, -1)]
    at += [(100 + i, 23, i * day // 7, i % 3 - 1) for i in range(40)]
    news = spark.createDataFrame(at, "article_id long, ticker long, us long, sentiment int")
    last = lambda t: None if t is None else int(str(t)[-1]) * (1 if t >= 0 else -1)

    def window(key, t, us):
        s = [r[3] for r in at if key(r[1]) == key(t) and (r[2] is None if us is None else r[2] is not None and us - day < r[2] <= us)]
        known = [x for x in s if x is not None]
        return (round(sum(known) / len(known), 6) if known else None, len(s))

    want = [(i, last(t), *window(last, t, us), t, *window(lambda x: x, t, us)) for i, t, us, _ in at]
    got = [tuple(r[c] for c in ("article_id", "ticker", "mean_24h", "n_24h", "own_ticker", "own_mean_24h", "own_n_24h")) for r in features.trailing_sentiment(news).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r[4] for r in got}) == 6
