"""Objects in replies, quarters in heads and turns on pages, on literal cases and against plain Python."""

import random
import re

from pyspark.sql import functions as F

from tapelab.functions import replies
from tapelab.operators import texts

T = texts


def test_first_object_cases(spark):
    cases = {
        '{"score": 42, "rationale": "Strong."}': {"score": 42, "rationale": "Strong."},
        '<think>let me see {"a": 1}</think>\n```json\n{"score": -75}\n```': {"score": -75},
        'first {"a": 1} then {"b": 2}': {"a": 1},
        '{"a": [1, 2,], "b": {"c": "x, }",},}': {"a": [1, 2], "b": {"c": "x, }"}},
        'set {x} is {"s": "a \\" } {"}': {"s": 'a " } {'},
        'an " odd mark {"a": 1}': {"a": 1},
        '{not json {"a": {"b": 1}}}': {"a": {"b": 1}},
        '{"a": 1': None, "I refuse.": None, "": None, "[1, 2]": None, "{}": {}, "{" * 3000: None, '{"' * 3000: None,
        '{"k": "line\nbreak"} {"k": 2}': {"k": 2},
    }
    for text, want in cases.items():
        assert replies.first_object(text) == want, text[:60]
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "reply string").select("reply", replies.json_object("reply").alias("body"))
    got = {r["reply"]: r["body"] for r in df.collect()}
    assert got[None] is None and {t for t, b in got.items() if b is None} == {None, *(t for t, w in cases.items() if w is None)}
    s = spark.createDataFrame([('{"score": 500}',), ('{"score": -500.4}',), ('{"score": "7.6"}',), ('{"score": "high"}',), ("{}",), (None,)], "r string").select(replies.score(F.col("r")).alias("s"))
    assert [r["s"] for r in s.collect()] == [100, -100, 8, None, None, None]


def plain_quarter(text):
    head, found = text[: T.HEAD_CHARS], []
    for kind, (pattern, q, y) in enumerate(T.QUARTER_PATTERNS):
        for m in re.finditer(pattern, head, re.I):
            later = bool(re.search(T.FORWARD_LOOKING, head[max(0, m.start() - T.FORWARD_CHARS) : m.start()], re.I))
            found.append((later, m.start(), kind, m[q].lower(), int(m[y])))
    if not found:
        return None
    _, _, _, q, y = min(found)
    return f"{y + 2000 if y < 100 else y}Q{dict(first=1, second=2, third=3, fourth=4).get(q) or int(q)}"


def test_quarters_of_heads(spark):
    r = random.Random(6)
    bits = ["first quarter of 2021", "Q3 FY22", "q1 2020", "fiscal year 2019 Fourth  quarter", "Second Quarter and full fiscal year 2018", "third quarter fiscal '23", "we expect", "Outlook:", "results", "and", "x" * 50, ".", "Q5 2020", "first quarter", "\n", "Q2'24"]
    heads = [" ".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(400)] + ["y" * 1490 + " Q1 2020", "y" * 1495 + " Q1 2020", "", "Q1 2020"]
    got = texts.quarter_from_text(spark.createDataFrame(list(enumerate([*heads, None])), "i int, head string"), "head").collect()
    assert {r["i"]: r["quarter"] for r in got} == {**dict(enumerate(map(plain_quarter, heads))), len(heads): None}
    assert got[0].__fields__ == ["i", "head", "quarter"] and sum(plain_quarter(h) is not None for h in heads) > 200


PANEL = dict(panel="<panel>", block="<turn", speaker="<who>(.*?)</who>", title="<role>(.*?)</role>", sentence="<s>(.*?)</s>")


def test_speaker_turns(spark):
    pages = [
        (1, "<turn><who>No</who><s>before</s><panel><turn><who>Ann <b>B</b></who><role>CEO, X &amp; Y</role><s>One\n two</s> <s> </s><s>three</s></turn><turn><s>goes on</s><turn><who>Cy</who></turn><turn><s>Cy's</s>"),
        (2, "<turn><who>Ann</who><s>no panel</s>"), (3, None), (4, ""), (5, "<panel><turn><s>nobody yet</s><turn><who>D</who><s>d</s>"),
    ]
    df = spark.createDataFrame(pages, "id int, html string")
    show = lambda carry: sorted((r["id"], r["nth"], r["speaker"], r["title"], r["sentences"]) for r in texts.speaker_turns(df, ["id"], "html", **PANEL, carry=carry).collect())
    ann = (1, 1, "Ann B", "CEO, X & Y", ["One two", "three"])
    assert show(False) == [ann, (5, 2, "D", None, ["d"])]
    assert show(True) == [ann, (1, 2, "Ann B", "CEO, X & Y", ["goes on"]), (1, 4, "Cy", None, ["Cy's"]), (5, 2, "D", None, ["d"])]
