"""Tables: the driver's Parquet files, and the market tables derived from them.

A derived table is one SELECT whose text both Spark and DuckDB run; the few functions that differ are named in braces.
Ordering keys are complete and arithmetic is on integers first, so both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

_SPARK = {"us": "unix_micros(CAST(ts AS TIMESTAMP))", "div": "div", "frac": "CAST(100 AS DOUBLE)"}
_DUCK = {"us": "epoch_us(ts)", "div": "//", "frac": "CAST(100 AS DOUBLE)"}

_SEQ = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

#: Figures of a call: (slot, value, period, scope, what was said of it, whether the transcript holds that). Some have another scope, an
#: unknown period, no quote, or one that the transcript doesn't hold.
_WHOLE, _Q, _P = "'whole_company'", "'quarter'", "'point_in_time'"
_FIGURES = (
    ("revenue", "revenue", _Q, _WHOLE, "concat('Revenue was reported at ', revenue, ' for the period ended ', end_date)", "revenue % 11 <> 0"),
    ("revenue_growth_yoy", "yoy", _Q, _WHOLE, "concat('Revenue changed by ', coalesce(yoy, 0), ' percent over the same quarter a year ago')", "true"),
    ("gaap_operating_income", "operating_cf - 2 * capex", _Q, _WHOLE, "CASE WHEN capex % 4 = 0 THEN concat('Operating income under GAAP was ', operating_cf - 2 * capex, ' in the quarter') ELSE '' END", "true"),
    ("gaap_net_income", "net_income", _Q, _WHOLE, "concat('Net income came to ', net_income, ' in the quarter that ended on ', end_date)", "true"),
    ("operating_cash_flow", "operating_cf", _Q, _WHOLE, "concat('Operations gave or took ', operating_cf, ' of cash in these three months')", "operating_cf % 5 <> 0"),
    ("free_cash_flow", "operating_cf - capex", "CASE WHEN capex % 6 = 1 THEN 'half_year' ELSE 'quarter' END", "CASE WHEN capex % 9 = 0 THEN 'segment' ELSE 'whole_company' END", "concat('After capital spending of ', capex, ' free cash flow was ', operating_cf - capex)", "true"),
    ("cash_and_investments", "capex * 50", _P, _WHOLE, "concat('Cash and investments stood at ', capex * 50)", "true"),
    ("customer_count", "100 + revenue % 50", "CASE WHEN revenue % 13 = 0 THEN 'decade' ELSE 'point_in_time' END", _WHOLE, "concat('customers ', 100 + revenue % 50)", "revenue % 3 <> 0"),
    ("net_dollar_retention", "80 + revenue % 41", _Q, _WHOLE, "CASE WHEN revenue % 5 = 0 THEN 'retention' ELSE concat('Net dollar retention was ', 80 + revenue % 41, ' percent for us') END", "true"),
    ("backlog", "revenue * (2 + revenue % 4)", _P, _WHOLE, "concat('The backlog is ', revenue * (2 + revenue % 4), ' at the end of the quarter')", "true"),
)
_SOFT = "concat('We believe in plan number ', n, ' of the year ', extract(YEAR FROM end_date))"
_CALLS = "(SELECT *, revenue * 100 {div} lag(revenue, 4) OVER (PARTITION BY ticker ORDER BY end_date) - 100 AS yoy FROM quarters) AS q"


def _by_slot(k: int) -> str:
    return "CASE slot " + " ".join(f"WHEN '{f[0]}' THEN {f[k]}" for f in _FIGURES) + " END"


def _letters(n: str) -> str:
    """A number as a capitalised word."""
    w = f"translate(concat('', {n}), '0123456789', 'bcdfghklmn')"
    return f"concat(upper(substr({w}, 1, 1)), substr({w}, 2, 9))"


#: Names of a company, its two programs and its speakers, from its ticker.
_COMPANY, _PROGRAM, _SECOND = f"concat({_letters('ticker * 97 + 1000')}, ' Works')", f"concat({_letters('ticker * 53 + 7')}, ' Generator')", f"concat({_letters('ticker * 59 + 11')}, ' Cells')"
_FIRST = "CASE {} % 6 WHEN 0 THEN 'Mark' WHEN 1 THEN 'Grace' WHEN 2 THEN 'Cash' WHEN 3 THEN 'Anna' WHEN 4 THEN 'Mary-Ann' ELSE 'Rosa' END"
_CEO, _CFO, _ANALYST = ((_FIRST.format(f"(ticker + {k})"), _letters(f"(ticker * {31 + 6 * k} + {k + 1}000)")) for k in (0, 1, 2))

#: name -> (tables it reads, text)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "tape": (("lineitem",), f"""
        SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS size, row_number() OVER ({_SEQ}) AS seq,
               20 * exp(CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) OVER ({_SEQ} {_ROWS}) AS DOUBLE) / {{frac}}) AS price
        FROM lineitem"""),
    "bars": (("tape",), """
        SELECT ticker, date, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close,
               sum(size) AS volume, sum(price * size) / sum(size) AS vwap, CAST(count(*) AS BIGINT) AS transactions
        FROM tape GROUP BY ticker, date"""),
    "index_bars": (("bars",), "SELECT CAST(0 AS BIGINT) AS ticker, date, avg(close) AS close FROM bars GROUP BY date"),
    "ticks": (("events",), f"""
        SELECT user_id AS ticker, ts, {{us}} AS us, event_id, value AS volume,
               20 * exp(CAST(sum((event_id * 7919) % 101 - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id {_ROWS}) AS DOUBLE) / CAST(10000 AS DOUBLE)) AS price
        FROM events"""),
    "news": (("events",), """
        SELECT event_id AS article_id, user_id AS ticker, ts AS published, {us} AS us,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS sentiment
        FROM events"""),
    "earnings": (("orders", "supplier"), """
        SELECT ticker, earnings_date, report_time, surprise_pct, eps_reported FROM (
            SELECT CAST(o_custkey % n + 1 AS BIGINT) AS ticker, CAST(o_orderdate AS DATE) AS earnings_date,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'BMO' ELSE 'AMC' END AS report_time,
                   CAST((o_orderkey * 37) % 401 - 200 AS DOUBLE) / 10 AS surprise_pct, o_totalprice / 100000 AS eps_reported,
                   row_number() OVER (PARTITION BY o_custkey % n, extract(YEAR FROM o_orderdate), extract(QUARTER FROM o_orderdate) ORDER BY o_orderkey) AS nth
            FROM orders CROSS JOIN (SELECT count(*) AS n FROM supplier) AS s) AS e
        WHERE nth = 1"""),
    "quarters": (("lineitem",), """
        SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start_date,
               CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN -3 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS net_income,
               CAST(sum(CASE WHEN l_linestatus = 'F' THEN -1 ELSE 2 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS operating_cf,
               CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS capex
        FROM lineitem GROUP BY 1, 2, 3"""),
    "facts": (("quarters",), """
        SELECT ticker, CASE WHEN k < 4 THEN 'Revenue' ELSE 'OperatingCF' END AS concept, CASE WHEN k < 3 THEN start_date ELSE y_start END AS start_date, CASE WHEN k = 3 THEN y_end ELSE end_date END AS end_date,
               CASE k WHEN 1 THEN revenue WHEN 2 THEN revenue + 100 WHEN 3 THEN y_revenue ELSE y_cf END AS val,
               CAST(CASE k WHEN 2 THEN end_date + INTERVAL 140 DAY WHEN 3 THEN y_end + INTERVAL 60 DAY ELSE end_date + INTERVAL 40 DAY END AS DATE) AS filed
        FROM (SELECT *, count(*) OVER y AS y_n, row_number() OVER s AS nth, min(start_date) OVER y AS y_start, max(end_date) OVER y AS y_end, CAST(sum(revenue) OVER y AS BIGINT) AS y_revenue, CAST(sum(operating_cf) OVER s AS BIGINT) AS y_cf
              FROM quarters WINDOW y AS (PARTITION BY ticker, extract(YEAR FROM end_date)), s AS (PARTITION BY ticker, extract(YEAR FROM end_date) ORDER BY end_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
        CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS kinds
        WHERE k = 4 OR (k = 3 AND y_n = 4 AND nth = 1) OR (k < 3 AND extract(QUARTER FROM end_date) < 4 AND (k = 1 OR (ticker + extract(YEAR FROM end_date) * 4 + extract(QUARTER FROM end_date)) % 7 = 0))"""),
    "filings": (("quarters",), "SELECT ticker, end_date, CAST(end_date + INTERVAL 25 DAY AS DATE) AS filing_date FROM quarters WHERE (ticker + extract(YEAR FROM end_date) * 4 + extract(QUARTER FROM end_date)) % 5 <> 0"),
    "splits": (("supplier",), "SELECT s_suppkey AS ticker, DATE '2000-01-03' AS split_date, CAST(2 AS DOUBLE) AS ratio FROM supplier WHERE s_suppkey % 4 = 0"),
    "sic": (("supplier",), "SELECT s_suppkey AS ticker, CAST(1000 + s_nationkey * 331 AS VARCHAR(4)) AS code FROM supplier"),
    "share_facts": (("quarters",), """
        SELECT ticker, start_date, end_date, 1000000 + revenue % 100000 AS val, CAST(end_date + INTERVAL 40 DAY AS DATE) AS filed FROM quarters WHERE extract(QUARTER FROM end_date) < 4 AND (ticker + extract(YEAR FROM end_date)) % 9 <> 0
        UNION ALL SELECT ticker, start_date, end_date, 7 + revenue % 100000, CAST(end_date + INTERVAL 140 DAY AS DATE) FROM quarters WHERE extract(QUARTER FROM end_date) < 4 AND (ticker + extract(YEAR FROM end_date)) % 9 = 4
        UNION ALL SELECT ticker, min(start_date), max(end_date), 1000000 + max(revenue) % 100000, CAST(max(end_date) + INTERVAL 60 DAY AS DATE) FROM quarters GROUP BY ticker, extract(YEAR FROM end_date) HAVING count(*) = 4"""),
    "ledger_raw": (("quarters",), f"""
        SELECT ticker, end_date, 'figures' AS list, slot, concat(chr(123), '"value": "', CASE WHEN value IS NULL THEN 'unknown' ELSE concat('$', value) END, '", "period": "', period, '", "scope": "', scope, '", "quote": "', quote, '", "prior_value_stated": ', CASE WHEN value % 4 = 0 THEN concat('"', value - 2, '"') ELSE 'null' END, chr(125)) AS entry
        FROM (SELECT ticker, end_date, slot, {_by_slot(1)} AS value, {_by_slot(2)} AS period, {_by_slot(3)} AS scope, {_by_slot(4)} AS quote FROM {_CALLS} CROSS JOIN ({" UNION ALL ".join(f"SELECT '{f[0]}' AS slot" for f in _FIGURES)}) AS s) AS f
        UNION ALL SELECT ticker, end_date, 'soft_evidence', concat('soft', n), concat(chr(123), '"kind": "', CASE WHEN n = 1 THEN 'pilot' WHEN n = 2 THEN 'hope' ELSE 'plan' END, '", "quote": "', CASE WHEN n = 4 THEN '' ELSE {_SOFT} END, '"', chr(125))
        FROM quarters CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) AS s WHERE capex % 9 >= n"""),
    "transcripts": (("quarters",), f"""
        SELECT ticker, end_date, concat_ws('. ', 'Good morning', {", ".join(f"CASE WHEN {f[5]} THEN {f[4]} END" for f in _FIGURES)}, 'Thank you') AS text FROM {_CALLS}"""),
    "calls": (("transcripts",), f"""
        SELECT ticker, end_date, concat_ws(chr(10), 'Operator', ceo, concat('CEO, ', company), concat('Good morning from ', company, ' in ', y, '. We ship the ', program, ', more ', program, 's and ', upper(second), '; ', lower(program), ' and ', second, 'X are not alike'),
                   text, cfo, concat('CFO, ', company), concat('Thanks, ', ceo_first, '. We mark the progress since ', y - 2, ' and until ', y + 1, '. Mr. ', ceo_last, '-', ceo_last, ' and TK', ticker, ' have more of ', second, '.'),
                   CASE WHEN nth % 2 = 0 THEN concat(analyst_first, ' ', analyst_last) END, concat('What of ', upper(cfo), ' and ', analyst_last, ' in 1999 or _2001'), concat('Each Grace ', {_letters('nth')})) AS text
        FROM (SELECT ticker, end_date, text, row_number() OVER (PARTITION BY ticker ORDER BY end_date) AS nth, extract(YEAR FROM end_date) AS y, {_COMPANY} AS company, {_PROGRAM} AS program, {_SECOND} AS second, {_CEO[0]} AS ceo_first, {_CEO[1]} AS ceo_last,
                     concat({_CEO[0]}, ' ', {_CEO[1]}) AS ceo, concat({_CFO[0]}, ' ', {_CFO[1]}) AS cfo, {_ANALYST[0]} AS analyst_first, {_ANALYST[1]} AS analyst_last FROM transcripts) AS t"""),
    "call_pages": (("calls",), """
        SELECT ticker, end_date, nth % 4 <> 3 AS has_panel, ceo, title, opening, body, cfo, cfo_title, thanks,
               concat('<html><body><div class="turn pt-5"><div class="who">Not Here</div><span class="say">before the panel</span></div>', CASE WHEN nth % 4 = 3 THEN '' ELSE '<section id="panel-full">' END,
                      '<div class="turn pt-5"><div class="who bold">', ceo, '</div><div class="role">', title, '</div><span class="say first" data-n="1">', opening, ' &amp; more</span> <span class="say"><b>', body, '</b>', chr(10), '  indeed</span></div>',
                      '<div class="turn pt-5"><div class="who">', cfo, '</div><div class="role">', cfo_title, '</div><span class="say">   </span></div>', '<div class="turn pt-5"><span class="say">nobody says this</span></div>',
                      '<div class="turn pt-5 last"><div class="who bold"> ', cfo, ' </div><span class="say">', thanks, '</span><span class="say"></span></div></section></body></html>') AS html
        FROM (SELECT ticker, end_date, split_part(text, chr(10), 2) AS ceo, split_part(text, chr(10), 3) AS title, split_part(text, chr(10), 4) AS opening, split_part(text, chr(10), 5) AS body, split_part(text, chr(10), 6) AS cfo, split_part(text, chr(10), 7) AS cfo_title, split_part(text, chr(10), 8) AS thanks,
                     row_number() OVER (PARTITION BY ticker ORDER BY end_date) AS nth FROM calls) AS c"""),
    "releases": (("transcripts",), """
        SELECT ticker, end_date, CASE WHEN kind = 6 THEN NULL WHEN kind = 1 THEN concat('20', substr(concat('', y), 3, 2), 'Q', q) ELSE concat(y, 'Q', q) END AS truth,
               concat(CASE kind WHEN 0 THEN concat('Results for the ', word, ' quarter of fiscal ', y) WHEN 1 THEN concat('Q', q, ' FY', substr(concat('', y), 3, 2), ' results') WHEN 2 THEN concat('Fiscal year ', y, ' ', word, ' quarter')
                           WHEN 3 THEN concat('We expect the Fourth Quarter of 2031 to be better. ', word, ' quarter and full year ', y) WHEN 4 THEN concat('Our outlook for Q1 2032 stays. More on that below, at some length and with care: the ', upper(word), ' QUARTER ', y)
                           WHEN 5 THEN concat('guidance for Q', q, ' ', y) ELSE 'Annual results' END, '. ', text) AS text
        FROM (SELECT ticker, end_date, text, extract(YEAR FROM end_date) AS y, extract(QUARTER FROM end_date) AS q, length(text) % 7 AS kind,
                     CASE extract(QUARTER FROM end_date) WHEN 1 THEN 'First' WHEN 2 THEN 'second' WHEN 3 THEN 'Third' ELSE 'fourth' END AS word FROM transcripts WHERE extract(YEAR FROM end_date) >= 2000 OR length(text) % 7 IN (1, 6)) AS t"""),
    "replies": (("events",), """
        SELECT event_id, translate(CASE event_id % 8 WHEN 0 THEN concat('~"k": ', v, '^') WHEN 1 THEN concat('<think>~"k": 1^ no, ~</think>', chr(10), '```json', chr(10), '~"k": ', v, '^', chr(10), '```') WHEN 2 THEN concat('Of ~this^ and ~that^: ~"k": ', v, '^ and ~"k": -1^')
                                                     WHEN 3 THEN concat('~"k": ', v, ', "more": ~"a": [1, 2,], ^,^') WHEN 4 THEN concat('~"note": "a ^ and a ', chr(92), '" ~", "k": ', v, '^ ~') WHEN 5 THEN concat('a " mark, then ~"k": ', v, ' , ^')
                                                     WHEN 6 THEN concat('~"k": ', v) ELSE 'I refuse to answer in JSON.' END, '~^', concat(chr(123), chr(125))) AS reply,
               CASE WHEN event_id % 8 < 6 THEN v END AS truth
        FROM (SELECT event_id, translate(props, concat(chr(123), chr(125), '"k: '), '') AS v FROM events) AS e"""),
    "alias_config": (("quarters",), f"""
        SELECT ticker, program, nth, CASE WHEN program = 0 AND nth = 1 THEN {_COMPANY} WHEN program = 0 AND nth = 2 THEN {_letters('ticker * 97 + 1000')} WHEN program = 0 THEN concat('TK', ticker)
                                          WHEN program = 1 AND nth = 1 THEN {_PROGRAM} WHEN program = 1 THEN {_letters('ticker * 53 + 7')} ELSE {_SECOND} END AS alias
        FROM (SELECT DISTINCT ticker FROM quarters) AS t CROSS JOIN (SELECT 0 AS program, 1 AS nth UNION ALL SELECT 0, 2 UNION ALL SELECT 0, 3 UNION ALL SELECT 1, 1 UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 1) AS a"""),
    "guesses": (("quarters",), f"""
        SELECT ticker, end_date, CASE revenue % 5 WHEN 0 THEN concat('I think it is ', {_COMPANY}, ', of course') WHEN 1 THEN concat('the maker of the ', lower({_PROGRAM}), 's?') WHEN 2 THEN concat('TK', ticker, 'X or TK', ticker + 1)
                                 WHEN 3 THEN concat({_letters('ticker * 97 + 1000')}, '/', 'others') END AS guess FROM quarters"""),
    "provenance": (("transcripts",), """
        SELECT ticker, end_date, md5(CASE WHEN length(text) % 7 = 0 THEN concat(text, ' (draft)') ELSE text END) AS text_hash, prior_end, CASE WHEN prior_text IS NULL THEN 'first_in_chain' ELSE 'linked' END AS chain,
               md5(CASE WHEN length(prior_text) % 5 = 0 THEN concat(prior_text, ' (draft)') ELSE prior_text END) AS prior_hash
        FROM (SELECT ticker, end_date, text, lag(text) OVER (PARTITION BY ticker ORDER BY end_date) AS prior_text, lag(end_date) OVER (PARTITION BY ticker ORDER BY end_date) AS prior_end FROM transcripts) AS t WHERE length(text) % 10 <> 3"""),
    "raw_scores": (("quarters",), """
        SELECT ticker, end_date, revenue % 140 - 20 AS ambition, capex % 110 AS proximity, revenue % 201 - 100 AS momentum, capex % 130 - 10 AS runway,
               CASE revenue % 4 WHEN 0 THEN 'pre_proof' WHEN 1 THEN 'early_proof' WHEN 2 THEN 'scaling' ELSE 'mature' END AS stage, revenue % 6 <> 0 AS goal_stated, capex % 4 AS targets FROM quarters"""),
    "panel": (("bars",), """
        SELECT ticker, date, close, high, low, nth, n,
               close / lag(close, 21) OVER w - 1 AS ret_21, close / lag(close, 5) OVER w - 1 AS ret_5,
               CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) = 63 THEN 1 - close / max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) END AS drawdown,
               max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) / close AS fwd_multiple,
               lead(close, 63) OVER w / close - 1 AS fwd_ret
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS nth, count(*) OVER (PARTITION BY ticker) AS n FROM bars) AS b
        WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "scored": (("panel",), """
        SELECT ticker, date, close, nth, round(ret_21, 9) AS ret_21, round(drawdown, 9) AS drawdown, round(fwd_multiple, 9) AS fwd_multiple, round(fwd_ret, 9) AS fwd_ret, CAST(extract(YEAR FROM date) AS INTEGER) AS year, round(drawdown + ret_21, 9) AS score,
               CASE WHEN fwd_multiple >= 1.3 THEN 1 ELSE 0 END AS label
        FROM panel WHERE drawdown IS NOT NULL AND fwd_ret IS NOT NULL AND (nth - 1 - 63) % 21 = 0"""),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table as a DataFrame."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = DERIVED[name]
    text = text.format(**_SPARK).replace("VARCHAR(4)", "STRING")
    frames = {n: load(spark, sf_dir, n) for n in needs}
    for n in needs:  # a table's name stands after FROM or JOIN only
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **frames)


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in DERIVED:
            out += [x for x in [*_ordered(DERIVED[n][0]), n] if x not in out]
    return list(dict.fromkeys(out))


def duckdb_sql(body: str, *names: str) -> str:
    """``body`` after the derived tables that it names, as one statement for DuckDB."""
    ctes = [f"{n} AS ({DERIVED[n][1].format(**_DUCK)})" for n in _ordered(names)]
    if not ctes:
        return body
    start = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = body.lstrip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if rest.upper().startswith(word):
            return start + ",\n".join(ctes) + ",\n" + rest[len(word) :]
    return start + ",\n".join(ctes) + "\n" + rest
