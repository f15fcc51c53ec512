"""Evidence ledgers of calls: what was claimed, whether the transcript holds it, and what follows for a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.functions import scalars as sc
from tapelab.sources.files import stored

CALL = ["ticker", "end_date"]
# Slots with unit and kind, periods with their number of quarters, kinds of soft evidence, tiers with their bands, stages in order.
SLOTS = {
    "revenue": ("money", "level"), "revenue_growth_yoy": ("pct", "rate"), "revenue_growth_qoq": ("pct", "rate"), "gross_margin": ("pct", "rate"),
    "gaap_operating_income": ("money", "profit"), "gaap_net_income": ("money", "profit"), "adjusted_operating_income": ("money", "profit"),
    "operating_cash_flow": ("money", "profit"), "free_cash_flow": ("money", "profit"), "cash_and_investments": ("money", "level"),
    "customer_count": ("count", "level"), "large_customer_count": ("count", "level"), "units_delivered": ("count", "level"),
    "net_dollar_retention": ("pct", "rate"), "recurring_revenue_share": ("pct", "rate"), "backlog": ("money", "level"), "bookings": ("money", "level"),
}
FLOW_PERIODS = {"quarter": 1, "half_year": 2, "nine_months": 3, "full_year": 4, "trailing_12m": 4}
PERIODS = (*FLOW_PERIODS, "point_in_time")
SOFT_KINDS = ("pilot", "pipeline", "assertion", "demand_signal", "partnership_without_figures", "plan", "other")
TIER_BANDS = {"T0": (0, 15), "T1": (5, 35), "T2": (20, 55), "T3": (35, 75), "T4": (50, 100)}
# Weights of what changed sign, of rates and profits, and of levels; how strongly rates (in points), profits and levels (as shares) move a score, and what counts as unchanged.
WEIGHTS, MOVES, UNCHANGED = {"flip": 6, "rate": 3, "profit": 3, "level": 1}, {"rate": 0.1, "profit": 2.0, "level": 4.0}, {"pct": 1.0, "share": 0.02}
STAGES = ("pre_proof", "early_proof", "scaling", "mature")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def quote_holds(quote: Column, source: Column, share: float = 0.6, k: int = 5) -> Column:
    """Whether ``share`` of the quote's word k-grams stand in ``source`` (words joined and enclosed by blanks). Shorter quotes must
    stand there whole and have two words at least; a null or empty quote doesn't hold."""

    def of(w: Column) -> Column:
        n = F.size(w)
        width = F.least(n, F.lit(k))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(w, i, width), " "), F.lit(" ")))
        found = F.size(F.filter(grams, lambda g: F.contains(source, g)))
        return (n >= 2) & (found >= F.lit(share) * F.size(grams))

    # the words are bound once, as an array of one element
    return F.coalesce(F.get(F.transform(F.array(tokens(quote)), of), F.lit(0)), F.lit(False))


def normalize_ledger(raw: DataFrame, transcripts: DataFrame) -> DataFrame:
    """ticker, end_date, list, slot, value, period, prior_value, kind, verified, reason of each raw entry (JSON in ``entry``).

    ``reason`` says why an entry was rejected and is null for accepted ones; unknown kinds of soft evidence are "other". Entries of a call
    without transcript are never verified.
    """
    e = raw.withColumn("e", F.from_json("entry", "value string, period string, scope string, quote string, prior_value_stated string, kind string"))
    source = transcripts.select(*CALL, F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" ")).alias("source"))
    figure = F.col("list") == "figures"
    quote = F.left(F.trim(F.coalesce("e.quote", F.lit(""))), F.lit(600))
    value = sc.lenient_number(F.col("e.value"))
    period = F.when(F.col("e.period").isin(*PERIODS), F.col("e.period"))
    reason = (
        F.when(figure & (F.coalesce("e.scope", F.lit("whole_company")) != "whole_company"), "scope")
        .when(figure & (value.isNull() | (quote == "") | period.isNull()), "incomplete")
        .when(~figure & (quote == ""), "no_quote")
    )
    kind = F.when(~figure, F.when(F.col("e.kind").isin(*SOFT_KINDS), F.col("e.kind")).otherwise("other"))
    j = e.join(source, CALL, "left")
    return j.select(
        *CALL, "list", "slot", F.when(figure, value).alias("value"), F.when(figure, period).alias("period"), F.when(figure, sc.lenient_number(F.col("e.prior_value_stated"))).alias("prior_value"),
        kind.alias("kind"), (reason.isNull() & quote_holds(quote, F.col("source"))).alias("verified"), reason.alias("reason"),
    )


def by_call(ledger: DataFrame) -> DataFrame:
    """A row per call, so that a ledger is gone through once: ticker, end_date, figures (the verified ones of known slots), now (the same by slot), hard, soft
    and unverified (how many), and prior_end, prior_figures and before of the call in the quarter before; null where that quarter has none."""
    accepted, figure, verified = F.col("reason").isNull(), F.col("list") == "figures", F.col("verified")
    keyed = F.col("ticker").isNotNull() & F.col("end_date").isNotNull()
    usable = keyed & figure & accepted & verified & F.col("slot").isin(*SLOTS)
    of_slot = lambda k: F.first(F.when(usable & (F.col("slot") == k), F.struct("value", "period", "prior_value")), ignorenulls=True).alias(k)
    g = ledger.groupBy(*CALL).agg(
        F.collect_list(F.when(usable, F.struct("slot", "value", "period"))).alias("figures"), F.struct(*map(of_slot, SLOTS)).alias("now"),
        F.count_if(accepted & figure & verified).alias("hard"), F.count_if(accepted & ~figure).alias("soft"), F.count_if(accepted & figure & ~verified).alias("unverified"),
    )
    w = Window.partitionBy("ticker").orderBy("end_date")
    number = lambda d: F.year(d) * 4 + F.quarter(d)
    g = g.withColumns({k: F.lag(c).over(w) for k, c in (("prior_end", "end_date"), ("prior_figures", "figures"), ("before", "now"))})
    linked = number(F.col("end_date")) - number(F.col("prior_end")) == 1
    return g.withColumns({k: F.when(linked, F.col(k)) for k in ("prior_figures", "before", "prior_end")})


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def compare_ledgers(ledger: DataFrame) -> DataFrame:
    """ticker, end_date, slot, value, prior, direction, weight, score of every slot that a linked call or the one before reports.

    Rates move by points, profits by their relative change or by turning sign, levels by their relative change. Figures of
    another period aren't compared. A call without a linked one before it has no rows.
    """
    return _compared(by_call(ledger)).filter("slot is not null")


def _compared(calls: DataFrame) -> DataFrame:
    """The rows of :func:`compare_ledgers` from those of :func:`by_call`, and one with a null slot for each call that has none."""
    none = F.lit(None).cast(calls.schema["figures"].dataType.elementType)
    now, then = F.when(F.col("prior_end").isNotNull(), F.col("figures")).otherwise(F.slice("figures", 1, 0)), F.coalesce("prior_figures", F.slice("figures", 1, 0))
    pair = lambda slot, c, p: F.struct(slot.alias("slot"), c.alias("c"), p.alias("p"))
    alike = lambda rows, x: F.filter(rows, lambda y: y["slot"] == x["slot"])
    missing = lambda rows, others: F.filter(rows, lambda x: F.size(alike(others, x)) == 0)
    pairs = F.concat(
        F.flatten(F.transform(now, lambda x: F.transform(alike(then, x), lambda y: pair(x["slot"], x, y)))),
        F.transform(missing(now, then), lambda x: pair(x["slot"], x, none)), F.transform(missing(then, now), lambda y: pair(y["slot"], none, y)),
    )
    t = calls.select(*CALL, F.inline_outer(pairs))
    by_slot = lambda k: F.create_map(*[F.lit(x) for s, v in SLOTS.items() for x in (s, v[k])])[F.col("slot")]
    t = t.withColumns({"unit": by_slot(0), "kind": by_slot(1)})
    c, p = F.col("c.value"), F.col("p.value")
    profit = F.col("kind") == "profit"
    flip = profit & (((p <= 0) & (c > 0)) | ((c <= 0) & (p > 0)))
    relative = (c - p) / F.greatest(F.abs(p), F.lit(1e-9))
    same = F.when(F.col("unit") == "pct", F.abs(c - p) < UNCHANGED["pct"]).otherwise(F.abs(c - p) <= UNCHANGED["share"] * F.greatest(F.abs(p), F.lit(1e-9)))
    both = F.col("c").isNotNull() & F.col("p").isNotNull() & (F.col("c.period") == F.col("p.period"))
    direction = (
        F.when(F.col("c").isNull(), "not_reported_now").when(F.col("p").isNull(), "not_reported_before").when(~both, "not_comparable_period")
        .when(flip, F.when(c > 0, "turned_positive").otherwise("turned_negative")).when(same, "unchanged").when(c > p, "improved").otherwise("worsened")
    )
    of_kind = lambda table: F.create_map(*[F.lit(x) for k in ("rate", "profit", "level") for x in (k, table[k])])[F.col("kind")]
    weight = F.when(~both, 0).when(flip, WEIGHTS["flip"]).otherwise(of_kind(WEIGHTS))
    score = F.when(flip, F.when(c > 0, 1.0).otherwise(-1.0)).when(same, 0.0).otherwise(clip(F.when(F.col("kind") == "rate", c - p).otherwise(relative) * of_kind(MOVES)))
    return t.select(*CALL, "slot", c.alias("value"), p.alias("prior"), direction.alias("direction"), weight.alias("weight"), F.when(both, score).otherwise(0.0).alias("score"))


def momentum(ledger: DataFrame) -> DataFrame:
    """ticker, end_date, basis, low, high of every call: the weighted mean of the compared scores, shrunk by a prior weight of 6 and
    rounded half to even, and the band around it; without a basis the band is -30 to 30."""
    return _momentum(by_call(ledger))


def _momentum(calls: DataFrame) -> DataFrame:
    counts = lambda c: F.sum(F.when(F.col("weight") > 0, c))
    compared = _compared(calls).groupBy(*CALL).agg(counts(F.col("weight")).alias("w"), counts(F.col("weight") * F.col("score")).alias("s"))
    basis = F.bround(F.round(100 * F.col("s") / (F.col("w") + 6), 9)).cast("int")
    t = compared.select(*CALL, basis.alias("basis"))
    low, high = F.greatest(F.col("basis") - 20, F.lit(-100)), F.least(F.col("basis") + 20, F.lit(100))
    known = lambda bound, else_: F.when(F.col("basis").isNotNull(), bound).otherwise(else_)
    return t.select(*CALL, "basis", known(low, -30).alias("low"), known(high, 30).alias("high"))


def hardness(ledger: DataFrame) -> DataFrame:
    """ticker, end_date, hardness (0 to 100), hard, soft, unverified: verified figures over those and soft evidence; what isn't verified counts on neither side."""
    return by_call(ledger).select(*CALL, "hard", "soft", "unverified", _hardness().alias("hardness"))


def _hardness() -> Column:
    return F.coalesce(F.bround(F.try_divide(100.0 * F.col("hard"), F.col("hard") + F.col("soft"))), F.lit(0.0)).cast("int")


def repeatable_base(ledger: DataFrame) -> DataFrame:
    """ticker, end_date, evidence (array), repeatable, and the figures ``now`` and ``before``: signs that revenue will come again. Repeatable
    needs revenue, its growth and a sign."""
    return _repeatable(by_call(ledger))


def _repeatable(t: DataFrame) -> DataFrame:
    v = lambda s: F.col(f"now.{s}.value")
    was = lambda s: F.col(f"before.{s}.value")
    same = lambda s: F.col(f"now.{s}.period") == F.col(f"before.{s}.period")
    no = lambda c: F.coalesce(c, F.lit(False))
    grew = lambda s: no(v(s) > F.col(f"now.{s}.prior_value")) | no(same(s) & (v(s) > was(s)))
    quarters = F.create_map(*[F.lit(x) for k, n in FLOW_PERIODS.items() for x in (k, n)])[F.col("now.revenue.period")]
    signs = [
        ("retention", no(v("net_dollar_retention") >= 100)), ("recurring", no(v("recurring_revenue_share") >= 50)),
        *((f"{s} grew", grew(s)) for s in ("customer_count", "large_customer_count", "units_delivered", "backlog")),
        ("growth twice", no(same("revenue_growth_yoy") & (v("revenue_growth_yoy") > 0) & (was("revenue_growth_yoy") > 0))),
        ("backlog of a year", no((v("revenue") * 4 / quarters != 0) & (v("backlog") >= v("revenue") * 4 / quarters))),
    ]
    t = t.withColumn("evidence", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in signs))))
    growing = no(v("revenue_growth_yoy") > 0) | grew("revenue")
    return t.withColumn("repeatable", F.col("now.revenue").isNotNull() & growing & (F.size("evidence") > 0))


def tiers(ledger: DataFrame) -> DataFrame:
    """ticker, end_date, tier, low, high, allowed (stages): how near profit a call is, its band with the caps for a base that doesn't repeat and for
    evidence that is mostly soft, and the stages that a score may name."""
    return _tiers(by_call(ledger))


def _tiers(calls: DataFrame) -> DataFrame:
    t = _repeatable(calls.filter("ticker is not null and end_date is not null")).withColumn("hardness", _hardness())
    v = lambda s: F.col(f"now.{s}.value")
    plus = lambda s: F.coalesce(v(s) > 0, F.lit(False))
    operating = v("gaap_operating_income")
    profitable = F.when(operating.isNotNull(), operating > 0).otherwise(plus("gaap_net_income"))
    net = plus("gaap_net_income") & ~F.coalesce(operating <= 0, F.lit(False))
    positive = plus("adjusted_operating_income") | plus("operating_cash_flow") | plus("free_cash_flow") | plus("gaap_operating_income") | net
    revenue, base = F.col("now.revenue").isNotNull(), F.col("repeatable")
    now, before = F.col("now.revenue_growth_yoy"), F.col("before.revenue_growth_yoy")
    sustained = F.coalesce((now["period"] == before["period"]) & (now["value"] >= before["value"] - 1.0), F.lit(False))
    tier = F.when(~revenue, "T0").when(~positive, "T1").when(~profitable, "T2").when(~(plus("free_cash_flow") & base), "T3").otherwise("T4")
    t = t.withColumn("tier", tier)
    bound = lambda k: F.create_map(*[F.lit(x) for n, b in TIER_BANDS.items() for x in (n, b[k])])[F.col("tier")]
    cap = F.when(~base, F.least(bound(1), F.lit(45))).otherwise(bound(1))
    low = F.least(bound(0), cap)
    high = F.when(F.col("hardness") < 50, F.greatest(low, F.floor((low + cap) / 2).cast("int"))).otherwise(cap)
    allowed = F.array_compact(F.array(F.lit("pre_proof"), F.when(revenue, "early_proof"), F.when(base & positive & sustained, "scaling"), F.when(profitable & plus("free_cash_flow") & base, "mature")))
    return t.select(*CALL, "tier", low.alias("low"), high.alias("high"), allowed.alias("allowed"), "now", "hardness")


def band(low: int, high: int) -> Column:
    return F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))


def runway(now: Column) -> Column:
    """Band (low, high) from the figures of a call: free cash flow, or else operating cash flow, against the cash balance."""
    flow = F.coalesce(now["free_cash_flow"], now["operating_cash_flow"])
    quarters = F.create_map(*[F.lit(x) for k, n in FLOW_PERIODS.items() for x in (k, n)])[flow["period"]]
    cash, burn = now["cash_and_investments"]["value"], -flow["value"] / quarters
    known = quarters.isNotNull()
    return (
        F.when(known & (burn <= 0), band(40, 100)).when(known & cash.isNull(), band(0, 40)).when(known & (cash / burn < 4), band(0, 25)).when(known & (cash / burn < 8), band(10, 45))
        .when(known & (cash / burn < 16), band(25, 65)).when(known, band(40, 80)).when(cash.isNotNull(), band(10, 60)).otherwise(band(0, 50))
    )


def runway_bands(ledger: DataFrame) -> DataFrame:
    """ticker, end_date, low, high: the band of each call's runway, from the verified cash flow and cash balance of its ledger."""
    return tiers(ledger).select(*CALL, runway(F.col("now")).alias("b")).select(*CALL, "b.low", "b.high")


def finalize_scores(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """ticker, end_date, ambition, proximity, momentum, runway, stage, clamped: raw scores kept in the bands that the ledger allows, and which fields that changed.

    A stage that isn't allowed becomes the highest allowed one below it, or else the last allowed one."""
    calls = stored(by_call(ledger), "calls")
    t = raw.join(_tiers(calls), CALL).join(_momentum(calls).select(*CALL, F.struct("low", "high").alias("m")), CALL)
    targets = F.when(~F.col("goal_stated"), band(0, 25)).when(F.col("targets") == 0, band(5, 55)).when(F.col("targets") == 1, band(15, 80)).otherwise(band(20, 100))
    bands = {"ambition": targets, "proximity": F.struct("low", "high"), "momentum": F.col("m"), "runway": runway(F.col("now"))}
    place = lambda s: F.array_position(F.array(*map(F.lit, STAGES)), s)
    lower = F.filter("allowed", lambda s: place(s) < place(F.col("stage")))
    stage = F.when(F.array_contains("allowed", F.col("stage")), F.col("stage")).when(F.size(lower) > 0, F.element_at(lower, -1)).otherwise(F.element_at("allowed", -1))
    kept = {k: F.greatest(F.least(F.col(k), b["high"]), b["low"]) for k, b in bands.items()} | {"stage": stage}
    clamped = F.array_join(F.array_compact(F.array(*(F.when(v != F.col(k), F.lit(k)) for k, v in kept.items()))), ",")
    return t.select(*CALL, *(v.alias(k) for k, v in kept.items()), clamped.alias("clamped"))


def call_state(calls: DataFrame, provenance: DataFrame) -> DataFrame:
    """ticker, end_date, state of each call (ticker, end_date, text): incomplete without stored provenance; stale where the stored hash of its text, its
    place in the chain or the stored hash of the text before isn't the current one; else complete."""
    w = Window.partitionBy("ticker").orderBy("end_date")
    now = calls.select(*CALL, F.md5(F.col("text").cast("binary")).alias("h"))
    now = now.withColumns({"before": F.lag("end_date").over(w), "before_h": F.lag("h").over(w)})
    j = now.join(provenance, CALL, "left")
    first = F.col("before").isNull()
    same_chain = F.when(first, F.col("chain") == "first_in_chain").otherwise((F.col("chain") == "linked") & F.col("prior_end").eqNullSafe(F.col("before")) & F.col("prior_hash").eqNullSafe(F.col("before_h")))
    return j.select(*CALL, F.when(F.col("text_hash").isNull(), "incomplete").when((F.col("text_hash") != F.col("h")) | ~same_chain, "stale").otherwise("complete").alias("state"))
