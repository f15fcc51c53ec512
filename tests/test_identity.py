"""Names in texts: against a plain single-pass replacement, with overlaps, shared names, odd letters and years."""

import random
import re

from pyspark.sql import functions as F

from tapelab.operators import identity as ident
from tapelab.plans.registry import QUERIES
from tapelab.sources.tables import load

SF = "/root/testdata/sf0.001"
YEAR = re.compile(r"\b(19|20)\d{2}\b")


def plain(text, table, year):
    """``table``: aliases in lower case to placeholders; one pattern, the longest alternative first."""
    if text is None:
        return None
    if table:
        pattern = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(re.escape(a) for a in sorted(table, key=len, reverse=True)) + r")(?![A-Za-z0-9])", re.IGNORECASE)
        text = pattern.sub(lambda m: table[m[0].lower()], text)
    return YEAR.sub(lambda m: f"Y{int(m[0]) - year:+d}", text)


def test_deidentify_against_one_pattern(spark):
    r = random.Random(2)
    words = ["ab", "a", "b", "AB", "ab-c", "c", "x1", "é", "ab ab", "(b)", "Person", "1", "2019", "19991", "_2001", "'s", "."]
    text = lambda: "".join(r.choice(words) + r.choice(["", " ", " ", "-"]) for _ in range(r.randint(0, 30)))
    tables = {k: {"".join(r.choice(["ab", "a", "b", " ", "-c", "1", "(b)", "é"]) for _ in range(r.randint(1, 4))).strip().lower() or "a": f"Person {i}" for i in range(6)} for k in (1, 2, 3)}
    rows = [(k, i, text(), 2000 + i % 5) for i in range(400) for k in (1, 2, 3, 4)] + [(1, -1, None, 2000), (None, -2, "ab a 2001", 2000), (2, -3, "", 2000)]
    docs = spark.createDataFrame(rows, "ticker long, id long, text string, y int").repartition(4)
    aliases = spark.createDataFrame([(k, a, p) for k, t in tables.items() for a, p in t.items()], "ticker long, alias string, placeholder string")
    want = sorted((str((k, i)), plain(t, tables.get(k, {}), y)) for k, i, t, y in rows)
    for max_bytes in (ident.MAX_ALIAS_BYTES, 500, 1):  # one automaton, a few parts, and a part an alias
        got = ident.deidentify(docs, aliases, "ticker", F.col("y"), max_bytes)
        assert got.columns == docs.columns
        assert sorted((str((x["ticker"], x["id"])), x["text"]) for x in got.collect()) == want, max_bytes
        if max_bytes == 500:
            assert ident.deidentify(docs.limit(0), aliases, "ticker").collect() == []
    assert sorted(x["text"] or "" for x in ident.deidentify(docs, aliases.limit(0), "ticker").collect()) == sorted(t or "" for _, _, t, _ in rows)


def test_query_equals_plain_replacement(spark):
    calls = load(spark, SF, "calls").collect()
    table = {}
    for r in QUERIES["txt7_alias_table"](spark, SF).collect():
        table.setdefault(r["ticker"], {})[r["alias"]] = r["placeholder"]
    got = {(r["ticker"], r["end_date"]): r["text"] for r in QUERIES["txt8_deidentify"](spark, SF).collect()}
    assert got == {(r["ticker"], r["end_date"]): plain(r["text"], table.get(r["ticker"], {}), r["end_date"].year) for r in calls}
    assert any("Person 1" in t and "Program 2" in t and "Company A" in t for t in got.values())


def test_alias_order_and_ordinary_words(spark):
    docs = spark.createDataFrame([(1, 1, "Mark Stone\nCEO, Acme\nwe mark it"), (1, 2, "Jo Stone\nhello\nJo Stone\nthanks, Stone"), (1, 3, "One Heading\nno"), (2, 1, None)], "ticker long, q int, text string")
    config = spark.createDataFrame([(1, 0, 1, "Acme"), (1, 1, 1, "Rover"), (1, 2, 1, "Wheels"), (1, 2, 2, "ACME")], "ticker long, program int, nth int, alias string")
    speakers = ident.people(docs, "ticker", "q")
    assert [(r["person"], r["n"], r["number"]) for r in speakers.orderBy("number").collect()] == [("Mark Stone", 1, 1), ("Jo Stone", 2, 2)]
    got = {r["alias"]: r["placeholder"] for r in ident.alias_table(config, speakers, ident.ordinary_words(docs, "ticker"), "ticker").collect()}
    assert got == {"acme": "Company A", "rover": "Program 1", "rovers": "Program 1", "wheels": "Program 2", "acmes": "Program 2", "mark stone": "Person 1", "jo stone": "Person 2", "stone": "Person 1", "jo": "Person 2"}


def test_lower_case_keeps_length():
    assert ident.lowered("İSTANBUL Straße") == "İstanbul straße" and len(ident.lowered("İ" * 5)) == 5


def test_recognition(spark):
    aliases = spark.createDataFrame([(1, "acme rockets"), (1, "ar"), (2, "b-2")], "ticker long, alias string")
    guesses = spark.createDataFrame([(1, "It is ACME  Rockets!"), (1, "acme and rockets"), (1, "far away"), (1, None), (2, "the B-2 maker"), (3, "acme rockets")], "ticker long, guess string")
    got = {r["ticker"]: (r["n"], r["recognised"]) for r in ident.recognition(guesses, aliases, "ticker").collect()}
    assert got == {1: (4, 0.25), 2: (1, 1.0), 3: (1, 0.0)}


def test_vocabularies_and_texts_are_not_broadcast(spark):
    """At 0.1 GB Spark takes a vocabulary's size for less than its limit for broadcasts, and the driver's memory doesn't hold it."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        w = spark.createDataFrame([(1, 1, "Alpha-Beta and Gamma Delta, gamma. Omega Sigma")], "ticker long, end_date int, text string")
        calls = spark.createDataFrame([(1, 1, "alpha"), (2, 1, "delta Sigma")], "ticker long, end_date int, text string")
        prompts = spark.createDataFrame([("the omega",)], "text string")
        got = ident.novel_terms(w, calls, prompts, calls, "ticker", ["ticker", "end_date"])
        assert sorted(r["term"] for r in got.collect()) == ["Alpha-Beta", "Sigma"]
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 4
        assert "SortMergeJoin" in ident.by_merge(w).join(calls, "ticker")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_text_meets_its_own_aliases_only(spark):
    """All keys' aliases in one automaton, in each task, made the job grow with texts times keys."""
    aliases = spark.createDataFrame([(k, f"name{k}", "Company A") for k in range(500)], "ticker long, alias string, placeholder string")
    docs = spark.createDataFrame([(k % 500, f"Name{k} and name{k + 1}") for k in range(1000)], "ticker long, text string")
    plan = ident.deidentify(docs, aliases, "ticker")._jdf.queryExecution().optimizedPlan()
    assert "Join LeftOuter" in plan.toString()
    got = sorted(r["text"] for r in ident.deidentify(docs, aliases, "ticker").collect())
    assert got == sorted([f"Company A and name{k + 1}" for k in range(500)] + [f"Name{k} and name{k + 1}" for k in range(500, 1000)])
