"""Literal frames for ledgers, quotes, valuations, best runs and ranks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tapelab.operators import evidence as e
from tapelab.operators import stats, texts, valuation

D = dt.date
Q = [D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30), D(2020, 12, 31), D(2021, 3, 31)]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_quotes_of_every_length(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta, epsilon zeta eta theta."), (2, "beta alpha"), (3, ""), (4, None), (5, "alpha")], "doc_id long, text string")
    quotes = [(1, "alpha"), (2, "Alpha, beta"), (3, "alpha beta gamma"), (4, "gamma delta epsilon zeta"), (5, "alpha gamma"), (6, ""), (7, None), (8, "alpha beta gamma delta epsilon zeta other words"), (9, "beta gamma delta epsilon zeta eta other"), (10, "alpha beta gamma delta epsilon")]
    got = rows(texts.verify_quotes(spark.createDataFrame(quotes, "item_id long, text string"), docs), "item_id", "doc_id")
    assert got == [(2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0), (9, 1, pytest.approx(2 / 3, abs=1e-6)), (10, 1, 1.0)]


def ledger(spark, calls):
    """calls: {end: {slot: (value, period, quote, more...)}}; a transcript holds every quote that doesn't begin with "not"."""
    raw, said = [], []
    for end, slots in calls.items():
        for slot, (value, period, quote, *more) in slots.items():
            raw.append((1, end, "soft_evidence" if slot.startswith("soft") else "figures", slot, json.dumps({"value": value, "period": period, "quote": quote, **(more[0] if more else {})})))
        said.append((1, end, ". ".join(q for _, _, q, *_ in slots.values() if q and not q.startswith("not"))))
    return e.normalize_ledger(spark.createDataFrame(raw, "ticker long, end_date date, list string, slot string, entry string"), spark.createDataFrame(said, "ticker long, end_date date, text string"))


def test_ledger_rejects_and_verifies(spark):
    quote = "the revenue was ten million in all"
    t = ledger(spark, {Q[0]: {
        "revenue": ("$1,234", "quarter", quote), "backlog": ("5", "decade", quote), "bookings": (None, "quarter", quote), "gross_margin": ("40%", "quarter", "", {}),
        "free_cash_flow": ("7", "quarter", quote, {"scope": "segment"}), "customer_count": ("3", "point_in_time", "not said on the call by anyone"), "soft1": (None, None, "we hope", {"kind": "hope"}), "soft2": (None, None, ""),
    }})
    got = {r["slot"]: (r["value"], r["kind"], r["verified"], r["reason"]) for r in t.collect()}
    assert got["revenue"] == (1234.0, None, True, None) and got["customer_count"] == (3.0, None, False, None)
    assert {k: v[3] for k, v in got.items() if v[3]} == {"backlog": "incomplete", "bookings": "incomplete", "gross_margin": "incomplete", "free_cash_flow": "scope", "soft2": "no_quote"}
    assert got["soft1"][1:3] == ("other", True)
    h = e.hardness(t).first()
    assert (h["hard"], h["soft"], h["unverified"], h["hardness"]) == (1, 1, 1, 50)


def test_comparison_momentum_and_tiers(spark):
    q = lambda n: f"{n} was said on the call by us all"
    calls = {
        Q[0]: {"revenue": ("100", "quarter", q("a")), "gaap_net_income": ("-5", "quarter", q("b")), "revenue_growth_yoy": ("10", "quarter", q("c")), "backlog": ("50", "point_in_time", q("d")), "bookings": ("9", "quarter", q("x"))},
        Q[1]: {"revenue": ("110", "quarter", q("a")), "gaap_net_income": ("5", "quarter", q("b")), "revenue_growth_yoy": ("10.5", "quarter", q("c")), "backlog": ("500", "half_year", q("d")), "free_cash_flow": ("2", "quarter", q("e")), "cash_and_investments": ("9", "point_in_time", q("f"))},
        Q[3]: {"revenue": ("1", "quarter", q("a"))},
    }
    t = ledger(spark, calls)
    got = {r["slot"]: (r["direction"], r["weight"], round(r["score"], 6)) for r in e.compare_ledgers(t).collect()}
    assert got == {
        "revenue": ("improved", 1, 0.4), "gaap_net_income": ("turned_positive", 6, 1.0), "revenue_growth_yoy": ("unchanged", 3, 0.0), "backlog": ("not_comparable_period", 0, 0.0),
        "free_cash_flow": ("not_reported_before", 0, 0.0), "cash_and_investments": ("not_reported_before", 0, 0.0), "bookings": ("not_reported_now", 0, 0.0),
    }
    assert rows(e.momentum(t), "end_date") == [(1, Q[0], None, -30, 30), (1, Q[1], 40, 20, 60), (1, Q[3], None, -30, 30)]  # 100 * 6.4 / 16, half to even
    tiers = {r["end_date"]: r for r in e.tiers(t).collect()}
    assert [(tiers[d]["tier"], tiers[d]["low"], tiers[d]["high"]) for d in (Q[0], Q[1], Q[3])] == [("T1", 5, 35), ("T4", 50, 100), ("T1", 5, 35)]
    assert tiers[Q[1]]["allowed"] == ["pre_proof", "early_proof", "scaling", "mature"] and tiers[Q[3]]["allowed"] == ["pre_proof", "early_proof"]
    raw = spark.createDataFrame([(1, Q[0], 90, 50, -50, 10, "mature", True, 1), (1, Q[1], 10, 50, 30, 20, "scaling", False, 0)], "ticker long, end_date date, ambition long, proximity long, momentum long, runway long, stage string, goal_stated boolean, targets long")
    assert rows(e.finalize_scores(raw, t), "end_date") == [(1, Q[0], 80, 35, -30, 10, "early_proof", "ambition,proximity,momentum,stage"), (1, Q[1], 10, 50, 30, 40, "scaling", "runway")]


def test_call_states(spark):
    calls = spark.createDataFrame([(1, d, f"text {n}") for n, d in enumerate(Q)], "ticker long, end_date date, text string")
    md5 = lambda n: spark.range(1).select(F.md5(F.lit(f"text {n}").cast("binary"))).first()[0]
    stored = [(1, Q[0], md5(0), None, "first_in_chain", None), (1, Q[1], md5(1), Q[0], "linked", md5(0)), (1, Q[2], "old", Q[1], "linked", md5(1)), (1, Q[3], md5(3), Q[2], "linked", "old")]
    p = spark.createDataFrame(stored, "ticker long, end_date date, text_hash string, prior_end date, chain string, prior_hash string")
    assert [r[2] for r in rows(e.call_state(calls, p), "end_date")] == ["complete", "complete", "stale", "stale", "incomplete"]


def test_shares_fall_back_to_the_year(spark):
    facts = [(1, D(2020, 1, 1), Q[0], 10, D(2020, 5, 1)), (1, D(2020, 1, 1), Q[0], 99, D(2020, 9, 1)), (1, D(2020, 1, 1), Q[3], 12, D(2021, 2, 1)), (1, D(2020, 4, 1), Q[1], 11, D(2020, 8, 1)), (1, D(2019, 7, 1), Q[1], 77, D(2020, 8, 1))]
    t = spark.createDataFrame(facts, "ticker long, start_date date, end_date date, val long, filed date")
    assert rows(valuation.diluted_shares(t), "end_date") == [(1, Q[0], 10), (1, Q[1], 11), (1, Q[3], 12)]


def test_market_values_undo_splits_and_need_positive_figures(spark):
    quarters = spark.createDataFrame([(1, d, 25, 10, n) for n, d in zip((0, 0, 30, 30, 40), Q)], "ticker long, end_date date, revenue long, operating_cf long, capex long")
    announced = quarters.select("ticker", "end_date", F.date_add("end_date", 10).alias("announced"))
    bars = spark.createDataFrame([(1, D(2021, 1, 9), 5.0), (1, D(2021, 1, 10), 50.0), (1, D(2021, 4, 9), 8.0), (1, D(2021, 6, 1), 16.0)], "ticker long, date date, close double")
    shares = spark.createDataFrame([(1, Q[3], 100)], "ticker long, end_date date, shares long")
    splits = spark.createDataFrame([(1, D(2021, 2, 1), 2.0), (1, D(2021, 5, 1), 3.0)], "ticker long, split_date date, ratio double")
    v = valuation.market_values(quarters, announced, bars, shares, splits)
    assert [(r["end_date"], r["mcap"], r["ps"], r["p_fcf"]) for r in v.orderBy("end_date").collect()] == [(Q[3], 3000.0, 30.0, None), (Q[4], 2400.0, 24.0, None)]
    assert rows(valuation.current_ps(v, bars), "ticker") == [(1, 48.0)]


def test_rise_takes_the_close_before_the_day(spark):
    series = spark.createDataFrame([(1, D(2020, 1, 3), 10.0), (1, D(2020, 1, 10), 20.0), (1, D(2020, 1, 17), 5.0)], "ticker long, date date, close double")
    events = spark.createDataFrame([(1, D(2020, 1, 10)), (1, D(2020, 1, 11)), (1, D(2020, 1, 3))], "ticker long, known date")
    assert rows(valuation.rise_since(events, series, "ticker", "known", "rise"), "known") == [(1, D(2020, 1, 3), None), (1, D(2020, 1, 10), -50.0), (1, D(2020, 1, 11), -75.0)]
    one = spark.createDataFrame([(-50.0, 100.0)], "a double, b double").select(valuation.relative_pct(F.col("a"), F.col("b"))).first()[0]
    assert one == -75.0


def test_best_run_smooths_and_keeps_to_its_segment(spark):
    def run(closes, **kw):
        b = spark.createDataFrame([(1, D(2020, 1, 1) + dt.timedelta(days=n), float(c), 1000.0) for n, c in enumerate(closes)], "ticker long, date date, close double, volume double")
        return [r.asDict() for r in valuation.best_run_by_segment(b, 3.0, 40, 1.0, 100.0, **kw).collect()]

    ramp = [10.0] * 10 + [10.0 + 2.5 * k for k in range(1, 21)]
    (r,) = run(ramp, smooth=1)
    assert r["multiple"] == pytest.approx(6.0) and r["start_price"] == 10.0 and r["peak_price"] == 60.0 and r["cross_date"] == D(2020, 1, 1) + dt.timedelta(days=17) and r["current_multiple"] == pytest.approx(6.0)
    spike = [10.0] * 15 + [60.0] + [10.0] * 15
    assert len(run(spike, smooth=1)) == 1 and run(spike, smooth=5) == []
    splice = [10.0] * 15 + [600.0] * 15  # another security under the same ticker
    assert run(splice, smooth=1, max_jump=10.0) == [] and len(run(splice, smooth=1, max_jump=100.0)) == 1
    assert run([0.1 * x for x in ramp[:12]] + [0.5] * 20, smooth=1) == []


def test_ranks_of_ranges_equal_sorted_ranks(spark):
    rng = random.Random(1)
    data = [(g, float(rng.choice([rng.randint(0, 40), 7, rng.random()])), rng.randint(0, 1)) for g in ("a", "b") for _ in range(800)] + [("a", None, 1)]
    t = spark.createDataFrame(data, "g string, x double, y int")
    got = {(r["g"], r["x"]): r["rank"] for r in stats.ranked_values(t, "x", ["g"], buckets=16).collect()}
    for g in ("a", "b"):
        xs = sorted(x for h, x, _ in data if h == g and x is not None)
        assert {x: got[g, x] for x in set(xs)} == {x: xs.index(x) + (xs.count(x) + 1) / 2 for x in set(xs)}


def test_ledger_is_gone_through_once(spark):
    """Entries and transcripts are parsed where a ledger is read, so each further reading parses them all again."""
    spec = "ticker long, end_date date, list string, slot string, value double, period string, prior_value double, kind string, verified boolean, reason string"
    row = lambda t, d, slot, v: (t, d, "figures", slot, v, "quarter", None, None, True, None)
    q1, q2, q4 = D(2020, 3, 31), D(2020, 6, 30), D(2020, 12, 31)
    led = spark.createDataFrame([row(1, q1, "revenue", 1.0), row(1, q1, "revenue", 2.0), row(1, q1, "backlog", 5.0), row(1, q2, "revenue", 4.0), row(1, q2, "bookings", 7.0), row(1, q4, "revenue", 9.0), row(None, q1, "revenue", 1.0), row(None, q2, "revenue", 1.0)], spec)
    for t in (e.compare_ledgers(led), e.momentum(led), e.tiers(led), e.runway_bands(led)):
        assert t._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = sorted((r["ticker"], r["end_date"], r["slot"], r["value"] or 0, r["prior"] or 0, r["direction"]) for r in e.compare_ledgers(led).collect())
    assert got == [(1, q2, "backlog", 0, 5.0, "not_reported_now"), (1, q2, "bookings", 7.0, 0, "not_reported_before"), (1, q2, "revenue", 4.0, 1.0, "improved"), (1, q2, "revenue", 4.0, 2.0, "improved")]
    assert {(r["ticker"], r["end_date"], r["basis"] is None) for r in e.momentum(led).collect()} == {(1, q1, True), (1, q2, False), (1, q4, True), (None, q1, True), (None, q2, True)}
    assert e.tiers(led).count() == 3
