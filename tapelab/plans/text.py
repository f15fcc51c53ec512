"""Text tables (TXT) and scalar expressions (SCL) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.functions import replies as replies_fn
from tapelab.functions import scalars as sc
from tapelab.operators import identity as ident
from tapelab.operators import texts as t
from tapelab.plans.registry import query

def _html_sql(c: str) -> str:
    c = rf"regexp_replace({c}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis')"
    c = rf"regexp_replace({c}, '</t[dh]>', ' | ', 'gi')"
    c = rf"regexp_replace({c}, '<(br|/p|/div|/tr|/li|/h[1-6])[^>]*>', chr(10), 'gi')"
    c = rf"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{text}')"
    return rf"trim(regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))"


@query("txt1_html_text", "pages", sql=f"SELECT page_id, md5({_html_sql('html')}) AS text_md5, length({_html_sql('html')}) AS chars FROM pages")
def html_text(pages):
    x = pages.select("page_id", sc.html_text(F.col("html")).alias("body"))
    return x.select("page_id", F.md5(F.col("body").cast("binary")).alias("text_md5"), F.char_length("body").cast("long").alias("chars"))


@query("txt2_speaker_turns", "conversations", sql=r"SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '')) AS sentences, length(text) AS chars FROM conversations WHERE trim(text) <> ''")
def turns(conversations):
    n = F.size(F.filter(F.split("text", r"[.!?]+"), lambda x: F.trim(x) != ""))
    return conversations.filter(F.trim("text") != "").select("conv_id", "turn", "role", n.cast("long").alias("sentences"), F.char_length("text").cast("long").alias("chars"))


PANEL = dict(panel='id="panel-full"', block=r'<div class="turn pt-5', speaker=r'<div class="who[^"]*">(.*?)</div>', title=r'<div class="role">(.*?)</div>', sentence=r'<span class="say[^"]*"[^>]*>(.*?)</span>')


@query("txt2_page_turns", "call_pages", sql="SELECT ticker, end_date, 1 AS nth, ceo AS speaker, title, opening || ' & more|' || body || ' indeed' AS said FROM call_pages WHERE has_panel UNION ALL SELECT ticker, end_date, 4, cfo, NULL, thanks FROM call_pages WHERE has_panel")
def page_turns(call_pages):
    """Speaker, title and sentences of the turns on a page; blocks without text, and without a speaker, are dropped."""
    turns = t.speaker_turns(call_pages, ["ticker", "end_date"], "html", **PANEL)
    return turns.select("ticker", "end_date", "nth", "speaker", "title", F.array_join("sentences", "|").alias("said"))


@query("txt3_quarter_from_text", "releases", sql="SELECT ticker, end_date, truth AS quarter FROM releases")
def quarter_from_text(releases):
    """The quarter that the head of a release names, in one of three ways, and not as an outlook."""
    return t.quarter_from_text(releases, "text").select("ticker", "end_date", "quarter")


@query("txt4_best_doc", "documents", sql="SELECT doc_id % 10 AS ticker, lang, max_by(doc_id, (n_chars, doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1, 2")
def best_doc(documents):
    return documents.groupBy((F.col("doc_id") % 10).alias("ticker"), "lang").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("txt5_discover_people", "documents", sql=r"WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line, string_split(text, chr(10))[i + 1] AS following FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) AS x), c AS (SELECT * FROM l WHERE regexp_full_match(line, '[A-Z][a-z]+( [A-Z][a-z]+){1,3}\.?')) SELECT line AS person, count(*) AS n FROM c GROUP BY line HAVING count(*) >= 2 OR bool_or(contains(coalesce(following, ''), ','))")
def people(documents):
    return t.discover_people(documents)


WORDS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


@query("txt6_vocab", "documents", sql=f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {WORDS} AS w GROUP BY word")
def vocab(documents):
    return t.vocabulary(documents)


_LINES = "l AS (SELECT ticker, end_date, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM calls), f AS (SELECT *, lead(line) OVER (PARTITION BY ticker, end_date ORDER BY i) AS following FROM l)"
PEOPLE = _LINES + r""", s AS (SELECT ticker, line AS person, count(*) AS n, min((end_date, i)) AS start FROM f WHERE regexp_full_match(line, '[A-Z][a-zA-Z.''-]+( [A-Z][a-zA-Z.''-]+){1,3}') AND line NOT LIKE '%.' GROUP BY ticker, line HAVING count(*) >= 2 OR bool_or(contains(coalesce(following, ''), ','))),
                         speakers AS (SELECT ticker, person, n, row_number() OVER (PARTITION BY ticker ORDER BY start, person) AS number FROM s)"""
ORDINARY = r"ordinary AS (SELECT DISTINCT ticker, unnest(regexp_extract_all(text, '\b[a-z][a-z''-]*\b')) AS word FROM calls)"
ALIASES = (
    r""", o AS (SELECT ticker, alias, CASE WHEN program = 0 THEN 'Company A' ELSE 'Program ' || program END AS placeholder, CASE WHEN program = 0 THEN 0 ELSE 1 END AS kind, program AS a, nth AS b, 0 AS c FROM alias_config),
         e AS (SELECT * FROM o UNION ALL SELECT ticker, alias || 's', placeholder, kind, a, b, 1 FROM o WHERE kind = 1 AND NOT lower(alias) LIKE '%s' UNION ALL SELECT ticker, person, 'Person ' || number, 2, number, 0, 0 FROM speakers
               UNION ALL SELECT ticker, alias, placeholder, 3, number, b, 0 FROM (SELECT ticker, number, 'Person ' || number AS placeholder, unnest([split_part(person, ' ', 1), split_part(person, ' ', -1)]) AS alias, unnest([0, 1]) AS b FROM speakers) AS x WHERE (ticker, lower(alias)) NOT IN (SELECT ticker, word FROM ordinary)),
         aliases AS (SELECT ticker, lower(alias) AS alias, arg_min(placeholder, (kind, a, b, c)) AS placeholder, length(lower(alias)) AS chars FROM e GROUP BY ticker, lower(alias))"""
)


@query("txt5_numbered_people", "calls", sql=f"WITH {PEOPLE} SELECT ticker, person, n, number FROM speakers")
def numbered_people(calls):
    return ident.people(calls, "ticker", "end_date")


def _alias_table(calls, alias_config):
    return ident.alias_table(alias_config, ident.people(calls, "ticker", "end_date"), ident.ordinary_words(calls, "ticker"), "ticker")


@query("txt7_alias_table", "calls", "alias_config", sql=f"WITH {PEOPLE}, {ORDINARY}{ALIASES} SELECT ticker, alias, placeholder, chars FROM aliases")
def aliases(calls, alias_config):
    """Names of companies and programs with their plurals, of people, and bare names that aren't ordinary words; the first placeholder wins."""
    return _alias_table(calls, alias_config)


@query("txt8_deidentify", "calls", "alias_config")
def deidentify(calls, alias_config):
    return ident.deidentify(calls, _alias_table(calls, alias_config), "ticker", F.year("end_date"))


@query("txt9_leak_terms", "documents", "benchmark", sql=r"WITH o AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS term FROM benchmark), s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS term FROM documents WHERE source <> 'src1') SELECT item_id, term FROM o WHERE term NOT IN (SELECT term FROM s)")
def leaks(documents, benchmark):
    proper = lambda d, *keep: d.select(*keep, F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).alias("term")).distinct()
    return proper(benchmark, "item_id").join(proper(documents.filter("source <> 'src1'")), "term", "left_anti").select("item_id", "term")


_TERMS_SQL = r"t AS (SELECT DISTINCT ticker, end_date, unnest(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*\b')) AS term FROM outputs), p AS (SELECT ticker, end_date, term, lower(part) AS word FROM (SELECT *, unnest(string_split(term, '-')) AS part FROM t) AS x WHERE length(part) >= 3 AND NOT regexp_full_match(part, '[0-9]+'))"


@query("set5_vocabulary_difference", "calls", "documents", sql=r"WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM calls), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM documents) SELECT word FROM a WHERE word NOT IN (SELECT word FROM b)")
def vocabulary_difference(calls, documents):
    """Words of calls that stand in no document."""
    return ident.vocabulary_difference(ident.lower_vocabulary(calls, []), ident.lower_vocabulary(documents, []), ["word"])


@query(
    "txt9_novel_terms", "releases", "calls", "alias_config", "benchmark",
    sql=rf"""WITH outputs AS (SELECT r.ticker, r.end_date, concat(r.text, '. Its ', a.alias, ' and the ', upper(a.alias), '-Plus') AS text FROM releases AS r JOIN alias_config AS a ON a.ticker = r.ticker + 1 AND a.program = 2), {_TERMS_SQL},
             s AS (SELECT DISTINCT ticker, end_date, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM calls), q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM benchmark),
             l AS (SELECT DISTINCT ticker, end_date, unnest(regexp_extract_all(text, '\b[a-z][a-z''-]*\b')) AS word FROM outputs), o AS (SELECT DISTINCT ticker, unnest(regexp_extract_all(text, '\b[a-z][a-z''-]*\b')) AS word FROM calls)
        SELECT DISTINCT ticker, end_date, term FROM p WHERE (ticker, end_date, word) NOT IN (SELECT ticker, end_date, word FROM s) AND word NOT IN (SELECT word FROM q) AND (ticker, end_date, word) NOT IN (SELECT ticker, end_date, word FROM l)
        AND NOT EXISTS (SELECT 1 FROM o WHERE o.word = p.word AND o.ticker <> p.ticker)""",
)
def novel_terms(releases, calls, alias_config, benchmark):
    """Terms that an output has from nowhere: not from its call, the prompts, or other companies' ordinary words. Outputs name a program of the next company."""
    other = alias_config.filter("program = 2").select((F.col("ticker") - 1).alias("ticker"), "alias")
    outputs = ident.by_merge(releases).join(other, "ticker").select("ticker", "end_date", F.concat("text", F.lit(". Its "), "alias", F.lit(" and the "), F.upper("alias"), F.lit("-Plus")).alias("text"))
    return ident.novel_terms(outputs, calls, benchmark, calls, "ticker", ["ticker", "end_date"])


@query("txt10_candidate_terms", "documents", sql=r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY term HAVING count(*) >= 5 AND count(DISTINCT doc_id) >= 3 ORDER BY n DESC, term LIMIT 60")
def candidates(documents):
    w = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")).filter("n >= 5 and docs >= 3").orderBy(F.desc("n"), "term").limit(60)


@query("txt10_identifying_terms", "calls", "alias_config", sql=rf"WITH {PEOPLE}, {ORDINARY}, t AS (SELECT ticker, end_date, unnest(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*\b')) AS term FROM calls), c AS (SELECT ticker, term, count(*) AS n, count(DISTINCT end_date) AS docs FROM t GROUP BY ticker, term HAVING count(*) >= 5 AND count(DISTINCT end_date) >= 3), d AS (SELECT * FROM c WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') AND lower(term) NOT IN ({', '.join(repr(w) for w in ident.STOP_TERMS)}) AND (ticker, lower(term)) NOT IN (SELECT ticker, word FROM ordinary) AND (ticker, lower(term)) NOT IN (SELECT ticker, unnest(string_split(lower(person), ' ')) FROM speakers) AND (ticker, lower(term)) NOT IN (SELECT ticker, unnest(regexp_extract_all(lower(alias), '[a-z0-9]+')) FROM alias_config WHERE program = 0)) SELECT ticker, term, n, docs FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, term) AS nth FROM d) AS x WHERE nth <= 60")
def identifying_terms(calls, alias_config):
    return ident.candidate_terms(calls, ident.people(calls, "ticker", "end_date"), ident.ordinary_words(calls, "ticker"), alias_config, "ticker")


@query("txt11_snippets", "documents", sql="SELECT term, min(doc_id) AS doc_id, min_by(substr(text, greatest(1, p - 60), length(term) + 120), doc_id) AS snippet FROM (SELECT term, doc_id, text, instr(text, term) AS p FROM documents CROSS JOIN (SELECT unnest(['license', 'License', 'idiot']) AS term) AS v) AS x WHERE p > 0 GROUP BY term")
def snippets(documents):
    x = documents.select("doc_id", "text", F.explode(F.array(*map(F.lit, ("license", "License", "idiot")))).alias("term")).withColumn("p", F.instr("text", F.col("term"))).filter("p > 0")
    cut = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("p") - 60), F.char_length("term") + 120)
    return x.select("term", "doc_id", cut.alias("snippet")).groupBy("term").agg(F.min("doc_id").alias("doc_id"), F.min_by("snippet", "doc_id").alias("snippet"))


@query("txt12_verify_quotes", "documents", "benchmark", sql=r"WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), g AS (SELECT item_id, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM q) AS x), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d) AS x), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id) SELECT g.item_id, dg.doc_id, round(count(*)::DOUBLE / max(n.n), 6) AS share FROM g JOIN dg ON dg.gram = g.gram JOIN n ON n.item_id = g.item_id GROUP BY 1, 2 HAVING count(*)::DOUBLE / max(n.n) >= 0.6 UNION ALL SELECT q.item_id, d.doc_id, 1.0::DOUBLE FROM q JOIN d ON len(q.w) BETWEEN 2 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(q.w, ' ') || ' ')")
def verify_quotes(documents, benchmark):
    return t.verify_quotes(benchmark, documents)


@query("txt13_recognition", "guesses", "calls", "alias_config", sql=f"WITH {PEOPLE}, {ORDINARY}{ALIASES} SELECT g.ticker, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM aliases AS a WHERE a.ticker = g.ticker AND contains(' ' || trim(regexp_replace(lower(coalesce(g.guess, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(a.alias, '[^a-z0-9]+', ' ', 'g')) || ' ')) THEN 1 ELSE 0 END), 6) AS recognised FROM guesses AS g GROUP BY g.ticker")
def recognition(guesses, calls, alias_config):
    return ident.recognition(guesses, _alias_table(calls, alias_config), "ticker")


@query("txt14_head_words", "documents", sql="SELECT doc_id, array_to_string(string_split(text, ' ')[1:20], ' ') AS head, left(text, 80) AS head_chars FROM documents")
def head_words(documents):
    return documents.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 20), " ").alias("head"), F.left("text", F.lit(80)).alias("head_chars"))


@query("scl1_lenient_number", "documents", sql=r"SELECT doc_id, try_cast(regexp_replace(trim(split_part(text, ' ', 2)), '[,$%\s]', '', 'g') AS DOUBLE) AS number, try_cast(regexp_replace('$' || n_chars || ',000%', '[,$%\s]', '', 'g') AS DOUBLE) AS money FROM documents")
def numbers(documents):
    return documents.select("doc_id", sc.lenient_number(F.split_part("text", F.lit(" "), F.lit(2))).alias("number"), sc.lenient_number(F.concat(F.lit("$"), F.col("n_chars").cast("string"), F.lit(",000%"))).alias("money"))


@query("scl2_first_json", "replies", sql="SELECT event_id, truth AS k, truth IS NOT NULL AS found FROM replies")
def first_json(replies):
    """The first object of a reply: after a thought, in a fence, between words, with trailing commas; without one, null."""
    x = replies.select("event_id", replies_fn.json_object("reply").alias("body"))
    return x.select("event_id", F.get_json_object("body", "$.k").alias("k"), F.col("body").isNotNull().alias("found"))


@query("scl2_reply_score", "replies", sql="SELECT event_id, CAST(greatest(-100, least(100, CAST(truth AS INTEGER) * 3 - 150)) AS INTEGER) AS score FROM replies WHERE truth IS NOT NULL")
def reply_score(replies):
    """Scores of replies that have one, kept between -100 and 100."""
    body = replies.select("event_id", F.get_json_object(replies_fn.json_object("reply"), "$.k").cast("double").alias("k")).filter("k is not null")
    reply = F.concat(F.lit("So: {\"score\": "), (F.col("k") * 3 - 150 + 0.25).cast("string"), F.lit(",}"))
    return body.select("event_id", replies_fn.score(replies_fn.json_object(reply)).alias("score"))


@query("scl3_clamp", "scored", sql="SELECT ticker, date, round(least(greatest(score, -0.05), 0.05), 6) AS score, CASE WHEN score < -0.05 OR score > 0.05 THEN 'score' ELSE '' END AS clamped FROM scored")
def clamped(scored):
    c = sc.clamp(F.col("score"), -0.05, 0.05)
    return scored.select("ticker", "date", F.round(c, 6).alias("score"), F.array_join(F.array_compact(F.array(F.when(c != F.col("score"), "score"))), ",").alias("clamped"))


@query("scl4_nearest_stage", "lineitem", sql="SELECT l_linenumber AS stage, CASE WHEN l_linenumber >= 5 THEN 5 WHEN l_linenumber >= 2 THEN 2 END AS allowed, count(*) AS n FROM lineitem GROUP BY 1, 2")
def nearest(lineitem):
    return lineitem.groupBy(F.col("l_linenumber").alias("stage"), sc.nearest_stage_below(F.col("l_linenumber"), (2, 5)).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("scl6_quarter_label", "quarters", sql="SELECT ticker, end_date, CAST(extract(YEAR FROM end_date) * 4 + extract(QUARTER FROM end_date) AS INTEGER) AS ordinal, CAST(extract(YEAR FROM end_date + 1) AS VARCHAR) || 'Q' || CAST(extract(QUARTER FROM end_date + 1) AS VARCHAR) AS next_label FROM quarters")
def labels(quarters):
    label = F.concat(F.year("end_date").cast("string"), F.lit("Q"), F.quarter("end_date").cast("string"))
    x = quarters.select("ticker", "end_date", label.alias("label"))
    return x.select("ticker", "end_date", sc.quarter_ordinal(F.col("label")).alias("ordinal"), sc.next_quarter(F.col("label")).alias("next_label"))


@query("scl7_label_number", "news", sql="SELECT article_id, CASE sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS label, sentiment AS number FROM news")
def label_number(news):
    label = F.when(F.col("sentiment") == 1, "positive").when(F.col("sentiment") == -1, "negative").otherwise("neutral")
    x = news.select("article_id", label.alias("label"))
    return x.select("article_id", "label", F.when(F.col("label") == "positive", 1).when(F.col("label") == "negative", -1).otherwise(0).alias("number"))


@query("scl8_report_time", "events", sql="SELECT event_id, CASE WHEN extract(HOUR FROM ts) >= 12 THEN 'AMC' ELSE 'BMO' END AS report_time FROM events")
def report_time(events):
    return events.select("event_id", sc.report_time(F.col("ts")).alias("report_time"))


@query("scl9_weekdays", "orders", sql="WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders) SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b) AS x WHERE isodow(d) <= 5")
def weekdays(orders):
    b = orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("z"))
    return b.select(F.explode(F.sequence("a", "z")).alias("day")).filter(F.weekday("day") < 5)


@query("scl12_keyword_flags", "documents", sql="SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'version') AS legal, contains(lower(text), 'idiot') OR contains(lower(text), 'worthless') AS rude FROM documents")
def keywords(documents):
    hit = lambda *ws: F.lower("text").contains(ws[0]) | F.lower("text").contains(ws[1])
    return documents.select("doc_id", hit("license", "version").alias("legal"), hit("idiot", "worthless").alias("rude"))


@query("scl13_content_hash", "documents", sql="SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS fingerprint FROM documents")
def fingerprint(documents):
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return documents.select("doc_id", F.sha2(F.concat_ws("|", blank("lang"), blank("source"), blank("text")).cast("binary"), 256).alias("fingerprint"))


@query("scl14_year_offsets", "transcripts", sql=r"SELECT ticker, end_date, array_to_string(list_transform(regexp_extract_all(text, '\d+|\D+'), lambda p: CASE WHEN regexp_full_match(p, '(19|20)\d\d') THEN 'Y' || CASE WHEN CAST(p AS INTEGER) >= extract(YEAR FROM end_date) THEN '+' ELSE '-' END || abs(CAST(p AS INTEGER) - extract(YEAR FROM end_date)) ELSE p END), '') AS text FROM transcripts")
def year_offsets(transcripts):
    """Years of a transcript relative to its own year, in one pass over its tokens."""
    return transcripts.select("ticker", "end_date", t.relative_years(F.col("text"), F.year("end_date")).alias("text"))


@query("scl15_growth", "quarters", sql="SELECT ticker, end_date, round(100.0 * net_income / revenue, 2) AS margin_pct FROM quarters")
def growth(quarters):
    return quarters.select("ticker", "end_date", F.round(F.try_divide(F.lit(100.0) * F.col("net_income"), F.col("revenue")), 2).alias("margin_pct"))


@query("scl16_symbols", "part", sql="SELECT p_partkey, replace(upper(trim(p_brand || '.' || p_size || ' ')), '.', '-') AS symbol FROM part")
def symbols(part):
    raw = F.concat("p_brand", F.lit("."), F.col("p_size").cast("string"), F.lit(" "))
    return part.select("p_partkey", F.replace(F.upper(F.trim(raw)), F.lit("."), F.lit("-")).alias("symbol"))
