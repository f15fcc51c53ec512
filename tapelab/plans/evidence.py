"""Evidence ledgers (LED10-18) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.operators import evidence as e
from tapelab.operators.windows import r6
from tapelab.plans.registry import query


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _by(col: str, values: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_num = lambda c: rf"try_cast(regexp_replace(trim({c}), '[,$%\s]', '', 'g') AS DOUBLE)"
LEDGER = rf"""j AS (SELECT ticker, end_date, list, slot, json_extract_string(entry, '$.value') AS jv, json_extract_string(entry, '$.period') AS jp, coalesce(json_extract_string(entry, '$.scope'), 'whole_company') AS js, trim(coalesce(json_extract_string(entry, '$.quote'), '')) AS jq, json_extract_string(entry, '$.prior_value_stated') AS jb, json_extract_string(entry, '$.kind') AS jk FROM ledger_raw),
    src AS (SELECT ticker, end_date, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS source FROM transcripts),
    t AS (SELECT *, regexp_extract_all(lower(jq), '[a-z0-9]+') AS w, list = 'figures' AS fig, {_num('jv')} AS v, CASE WHEN jp IN {_in(e.PERIODS)} THEN jp END AS per FROM j),
    led AS (SELECT t.ticker, t.end_date, list, slot, CASE WHEN fig THEN v END AS value, CASE WHEN fig THEN per END AS period, CASE WHEN fig THEN {_num('jb')} END AS prior_value, CASE WHEN NOT fig THEN CASE WHEN jk IN {_in(e.SOFT_KINDS)} THEN jk ELSE 'other' END END AS kind,
        CASE WHEN fig AND js <> 'whole_company' THEN 'scope' WHEN fig AND (v IS NULL OR jq = '' OR per IS NULL) THEN 'incomplete' WHEN NOT fig AND jq = '' THEN 'no_quote' END AS reason,
        CASE WHEN len(w) < 2 THEN false WHEN len(w) < 5 THEN contains(source, ' ' || array_to_string(w, ' ') || ' ') ELSE len(list_filter(generate_series(1, len(w) - 4), lambda i: contains(source, ' ' || array_to_string(w[i : i + 4], ' ') || ' '))) >= 0.6::DOUBLE * (len(w) - 4) END AS holds
        FROM t JOIN src ON src.ticker = t.ticker AND src.end_date = t.end_date)"""
FIGURES = f"""{LEDGER}, fg AS (SELECT ticker, end_date, slot, value, period, prior_value FROM led WHERE list = 'figures' AND reason IS NULL AND holds),
    c0 AS (SELECT DISTINCT ticker, end_date FROM ledger_raw), c1 AS (SELECT *, lag(end_date) OVER (PARTITION BY ticker ORDER BY end_date) AS b FROM c0),
    calls AS (SELECT ticker, end_date, CASE WHEN extract(YEAR FROM end_date) * 4 + extract(QUARTER FROM end_date) - extract(YEAR FROM b) * 4 - extract(QUARTER FROM b) = 1 THEN b END AS prior_end FROM c1)"""
COMPARED = f"""{FIGURES}, nw AS (SELECT fg.* FROM fg JOIN calls USING (ticker, end_date) WHERE prior_end IS NOT NULL), th AS (SELECT calls.ticker, calls.end_date, fg.slot, fg.value, fg.period FROM calls JOIN fg ON fg.ticker = calls.ticker AND fg.end_date = calls.prior_end),
    m0 AS (SELECT coalesce(nw.ticker, th.ticker) AS ticker, coalesce(nw.end_date, th.end_date) AS end_date, coalesce(nw.slot, th.slot) AS slot, nw.value AS c, th.value AS p, nw.period AS cp, th.period AS pp FROM nw FULL JOIN th ON th.ticker = nw.ticker AND th.end_date = nw.end_date AND th.slot = nw.slot),
    m1 AS (SELECT *, {_by('slot', {k: f"'{v[0]}'" for k, v in e.SLOTS.items()})} AS unit, {_by('slot', {k: f"'{v[1]}'" for k, v in e.SLOTS.items()})} AS kind FROM m0),
    m2 AS (SELECT *, coalesce(cp = pp, false) AS alike, kind = 'profit' AND ((p <= 0 AND c > 0) OR (c <= 0 AND p > 0)) AS flip, CASE WHEN unit = 'pct' THEN abs(c - p) < 1 ELSE abs(c - p) <= 0.02::DOUBLE * greatest(abs(p), 1e-9::DOUBLE) END AS same, (c - p) / greatest(abs(p), 1e-9::DOUBLE) AS rel FROM m1),
    cmp AS (SELECT ticker, end_date, slot, c AS value, p AS prior, CASE WHEN c IS NULL THEN 'not_reported_now' WHEN p IS NULL THEN 'not_reported_before' WHEN NOT alike THEN 'not_comparable_period' WHEN flip THEN CASE WHEN c > 0 THEN 'turned_positive' ELSE 'turned_negative' END WHEN same THEN 'unchanged' WHEN c > p THEN 'improved' ELSE 'worsened' END AS direction,
        CASE WHEN NOT alike THEN 0 WHEN flip THEN 6 WHEN kind = 'level' THEN 1 ELSE 3 END AS weight,
        CASE WHEN NOT alike THEN 0 WHEN flip THEN CASE WHEN c > 0 THEN 1 ELSE -1 END WHEN same THEN 0 ELSE least(greatest(CASE kind WHEN 'rate' THEN (c - p) * 0.1::DOUBLE WHEN 'profit' THEN rel * 2 ELSE rel * 4 END, -1), 1) END::DOUBLE AS score FROM m2)"""
MOMENTUM = f"""{COMPARED}, mb AS (SELECT ticker, end_date, CAST(round_even(round(100 * sum(weight * score) / (sum(weight) + 6), 9), 0) AS INTEGER) AS basis FROM cmp WHERE weight > 0 GROUP BY 1, 2),
    mom AS (SELECT calls.ticker, calls.end_date, basis, CASE WHEN basis IS NULL THEN -30 ELSE greatest(basis - 20, -100) END AS low, CASE WHEN basis IS NULL THEN 30 ELSE least(basis + 20, 100) END AS high FROM calls LEFT JOIN mb USING (ticker, end_date))"""
HARD = """hd AS (SELECT ticker, end_date, count(*) FILTER (reason IS NULL AND list = 'figures' AND holds) AS hard, count(*) FILTER (reason IS NULL AND list <> 'figures') AS soft, count(*) FILTER (reason IS NULL AND list = 'figures' AND NOT holds) AS unverified FROM led GROUP BY 1, 2),
    hs AS (SELECT *, CAST(CASE WHEN hard + soft > 0 THEN round_even(100::DOUBLE * hard / (hard + soft), 0) ELSE 0 END AS INTEGER) AS hardness FROM hd)"""
_SHORT = {"revenue": "rev", "revenue_growth_yoy": "gr", "gaap_operating_income": "op", "gaap_net_income": "ni", "adjusted_operating_income": "adj", "operating_cash_flow": "ocf", "free_cash_flow": "fcf", "cash_and_investments": "cash", "customer_count": "cust", "large_customer_count": "large", "units_delivered": "units", "net_dollar_retention": "ndr", "recurring_revenue_share": "rec", "backlog": "bl"}
_cols = ", ".join(f"max({c}) FILTER (slot = '{s}') AS {n}{k}" for s, n in _SHORT.items() for c, k in (("value", ""), ("period", "_p"), ("prior_value", "_b")))
_grew = lambda n: f"(coalesce(n.{n} > n.{n}_b, false) OR coalesce(n.{n}_p = b.{n}_p AND n.{n} > b.{n}, false))"
_yes = lambda c: f"coalesce({c}, false)"
_quarters = _by("n.rev_p", e.FLOW_PERIODS)
_signs = [
    (_yes("n.ndr >= 100"), "retention"), (_yes("n.rec >= 50"), "recurring"), *((_grew(_SHORT[s]), f"{s} grew") for s in ("customer_count", "large_customer_count", "units_delivered", "backlog")),
    (_yes("n.gr_p = b.gr_p AND n.gr > 0 AND b.gr > 0"), "growth twice"), (_yes(f"n.rev * 4 / {_quarters} <> 0 AND n.bl >= n.rev * 4 / {_quarters}"), "backlog of a year"),
]
BASE = f"""{MOMENTUM}, {HARD}, wide AS (SELECT ticker, end_date, {_cols} FROM fg GROUP BY 1, 2),
    w2 AS (SELECT calls.*, n.* EXCLUDE (ticker, end_date), concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _signs)}) AS evidence, {_yes("n.gr > 0")} OR {_grew("rev")} AS growing, {_yes("n.gr_p = b.gr_p AND n.gr >= b.gr - 1")} AS sustained
        FROM calls LEFT JOIN wide AS n ON n.ticker = calls.ticker AND n.end_date = calls.end_date LEFT JOIN wide AS b ON b.ticker = calls.ticker AND b.end_date = calls.prior_end),
    base AS (SELECT *, rev IS NOT NULL AND growing AND evidence <> '' AS repeatable FROM w2)"""
TIERS = f"""{BASE}, p0 AS (SELECT base.*, hardness, CASE WHEN op IS NOT NULL THEN op > 0 ELSE {_yes("ni > 0")} END AS profitable, {_yes("fcf > 0")} AS free, {_yes("adj > 0")} OR {_yes("ocf > 0")} OR {_yes("fcf > 0")} OR {_yes("op > 0")} OR ({_yes("ni > 0")} AND NOT {_yes("op <= 0")}) AS positive FROM base JOIN hs USING (ticker, end_date)),
    p1 AS (SELECT *, CASE WHEN rev IS NULL THEN 'T0' WHEN NOT positive THEN 'T1' WHEN NOT profitable THEN 'T2' WHEN NOT (free AND repeatable) THEN 'T3' ELSE 'T4' END AS tier FROM p0),
    p2 AS (SELECT *, CASE WHEN repeatable THEN {_by("tier", {k: v[1] for k, v in e.TIER_BANDS.items()})} ELSE least({_by("tier", {k: v[1] for k, v in e.TIER_BANDS.items()})}, 45) END AS cap, {_by("tier", {k: v[0] for k, v in e.TIER_BANDS.items()})} AS floor0 FROM p1),
    tier AS (SELECT *, least(floor0, cap) AS low, CASE WHEN hardness < 50 THEN greatest(least(floor0, cap), (least(floor0, cap) + cap) // 2) ELSE cap END AS high,
        concat_ws(',', 'pre_proof', CASE WHEN rev IS NOT NULL THEN 'early_proof' END, CASE WHEN repeatable AND positive AND sustained THEN 'scaling' END, CASE WHEN profitable AND free AND repeatable THEN 'mature' END) AS allowed FROM p2)"""
_burn = f"(-coalesce(fcf, ocf) / {_by('coalesce(fcf_p, ocf_p)', e.FLOW_PERIODS)})"
_known = f"coalesce(fcf_p, ocf_p) IN {_in(e.FLOW_PERIODS)}"


def _runway(k: int) -> str:
    v = lambda a, b: (a, b)[k]
    return f"CASE WHEN {_known} THEN CASE WHEN {_burn} <= 0 THEN {v(40, 100)} WHEN cash IS NULL THEN {v(0, 40)} WHEN cash / {_burn} < 4 THEN {v(0, 25)} WHEN cash / {_burn} < 8 THEN {v(10, 45)} WHEN cash / {_burn} < 16 THEN {v(25, 65)} ELSE {v(40, 80)} END WHEN cash IS NOT NULL THEN {v(10, 60)} ELSE {v(0, 50)} END"


_stages = "['pre_proof', 'early_proof', 'scaling', 'mature']"
FINAL = f"""{TIERS}, f0 AS (SELECT r.*, CASE WHEN NOT goal_stated THEN 0 WHEN targets = 0 THEN 5 WHEN targets = 1 THEN 15 ELSE 20 END AS al, CASE WHEN NOT goal_stated THEN 25 WHEN targets = 0 THEN 55 WHEN targets = 1 THEN 80 ELSE 100 END AS ah, t.low AS pl, t.high AS ph, m.low AS ml, m.high AS mh, {_runway(0)} AS rl, {_runway(1)} AS rh, string_split(allowed, ',') AS al_stages
        FROM raw_scores AS r JOIN tier AS t ON t.ticker = r.ticker AND t.end_date = r.end_date JOIN mom AS m ON m.ticker = r.ticker AND m.end_date = r.end_date),
    f1 AS (SELECT *, list_filter(al_stages, lambda s: list_position({_stages}, s) < list_position({_stages}, stage)) AS lower_stages FROM f0),
    f2 AS (SELECT ticker, end_date, ambition AS a0, proximity AS p0_, momentum AS m0_, runway AS r0, stage AS s0, greatest(least(ambition, ah), al) AS ambition, greatest(least(proximity, ph), pl) AS proximity, greatest(least(momentum, mh), ml) AS momentum, greatest(least(runway, rh), rl) AS runway, CASE WHEN list_contains(al_stages, stage) THEN stage WHEN len(lower_stages) > 0 THEN lower_stages[-1] ELSE al_stages[-1] END AS stage FROM f1)"""


@query("led10_normalize_ledger", "ledger_raw", "transcripts", sql=f"WITH {LEDGER} SELECT ticker, end_date, list, slot, value, period, prior_value, kind, coalesce(reason IS NULL AND holds, false) AS verified, reason FROM led")
def normalize(ledger_raw, transcripts):
    return e.normalize_ledger(ledger_raw, transcripts)


@query("led11_compare_ledgers", "ledger_raw", "transcripts", sql=f"WITH {COMPARED} SELECT ticker, end_date, slot, value, prior, direction, weight, round(score, 6) AS score FROM cmp")
def compare(ledger_raw, transcripts):
    return e.compare_ledgers(e.normalize_ledger(ledger_raw, transcripts)).withColumn("score", r6("score"))


@query("led12_momentum", "ledger_raw", "transcripts", sql=f"WITH {MOMENTUM} SELECT * FROM mom")
def momentum(ledger_raw, transcripts):
    return e.momentum(e.normalize_ledger(ledger_raw, transcripts))


@query("led13_hardness", "ledger_raw", "transcripts", sql=f"WITH {LEDGER}, {HARD} SELECT * FROM hs")
def hardness(ledger_raw, transcripts):
    return e.hardness(e.normalize_ledger(ledger_raw, transcripts))


@query("led14_repeatable_base", "ledger_raw", "transcripts", sql=f"WITH {BASE} SELECT ticker, end_date, evidence, repeatable FROM base")
def repeatable(ledger_raw, transcripts):
    return e.repeatable_base(e.normalize_ledger(ledger_raw, transcripts)).select(*e.CALL, F.array_join("evidence", ",").alias("evidence"), "repeatable")


@query("led15_tiers", "ledger_raw", "transcripts", sql=f"WITH {TIERS} SELECT ticker, end_date, tier, low, CAST(high AS INTEGER) AS high, allowed FROM tier")
def tiers(ledger_raw, transcripts):
    return e.tiers(e.normalize_ledger(ledger_raw, transcripts)).select(*e.CALL, "tier", "low", "high", F.array_join("allowed", ",").alias("allowed"))


@query("led16_runway_cash", "raw_scores", "ledger_raw", "transcripts", sql=f"WITH {FINAL} SELECT ticker, end_date, rl AS low, rh AS high FROM f0")
def runway_cash(raw_scores, ledger_raw, transcripts):
    """Bands of calls that were scored, by verified cash and cash flow."""
    calls = raw_scores.select("ticker", "end_date")
    return e.runway_bands(e.normalize_ledger(ledger_raw, transcripts)).join(calls, ["ticker", "end_date"], "left_semi")


@query("led17_finalize_scores", "raw_scores", "ledger_raw", "transcripts", sql=f"WITH {FINAL} SELECT ticker, end_date, ambition, proximity, momentum, runway, stage, concat_ws(',', CASE WHEN ambition <> a0 THEN 'ambition' END, CASE WHEN proximity <> p0_ THEN 'proximity' END, CASE WHEN momentum <> m0_ THEN 'momentum' END, CASE WHEN runway <> r0 THEN 'runway' END, CASE WHEN stage <> s0 THEN 'stage' END) AS clamped FROM f2")
def finalize(raw_scores, ledger_raw, transcripts):
    return e.finalize_scores(raw_scores, e.normalize_ledger(ledger_raw, transcripts))


@query("led18_call_state", "transcripts", "provenance", sql="WITH c AS (SELECT ticker, end_date, md5(text) AS h, lag(md5(text)) OVER w AS bh, lag(end_date) OVER w AS b FROM transcripts WINDOW w AS (PARTITION BY ticker ORDER BY end_date)) SELECT c.ticker, c.end_date, CASE WHEN p.text_hash IS NULL THEN 'incomplete' WHEN p.text_hash <> h THEN 'stale' WHEN b IS NULL AND chain = 'first_in_chain' THEN 'complete' WHEN chain = 'linked' AND p.prior_end = b AND p.prior_hash = bh THEN 'complete' ELSE 'stale' END AS state FROM c LEFT JOIN provenance AS p ON p.ticker = c.ticker AND p.end_date = c.end_date")
def call_state(transcripts, provenance):
    return e.call_state(transcripts, provenance)
