"""JSON objects out of free text, such as a model's reply."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_THOUGHT = re.compile(r"<think>.*?</think>", re.S | re.I)
_MARKS = re.compile(r'["\\{}]')


_DECODER = json.JSONDecoder()


def brace_ends(text: str) -> dict[int, int]:
    """Behind which place each opening brace is balanced. Braces in strings don't count; as prose may hold a single quote mark, each
    brace is read with the marks before it counted, and with one more. Two passes over the text."""
    ends: dict[int, int] = {}
    for quoted in (False, True):
        open_, at = [], 0
        while m := _MARKS.search(text, at):
            c, at = m[0], m.end()
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = not quoted
            elif quoted:
                continue
            elif c == "{":
                open_.append(m.start())
            elif open_:
                ends[open_.pop()] = at
    return ends


def without_trailing_commas(text: str) -> str:
    """The text without commas before a closing brace or bracket, outside strings."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.S)


def first_object(text: str | None) -> dict | None:
    """The first JSON object in a text, after its thoughts are cut out; trailing commas are forgiven; None if there is none."""
    if text is None:
        return None
    text = _THOUGHT.sub("", text)
    ends = None
    start = text.find("{")
    while start >= 0:
        try:
            return _DECODER.raw_decode(text, start)[0]
        except json.JSONDecodeError as e:
            if "," in text[max(start, e.pos - 1) : e.pos + 1] or text[start : e.pos].rstrip().endswith(","):
                ends = brace_ends(text) if ends is None else ends
                if start in ends:
                    try:
                        return json.loads(without_trailing_commas(text[start : ends[start]]))
                    except (ValueError, RecursionError):
                        pass
        except RecursionError:
            pass
        start = text.find("{", start + 1)
    return None


@pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    found = (first_object(t) for t in texts)
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], dtype=object)


def json_object(c: Column | str) -> Column:
    """The first JSON object of each text, as JSON; null where there is none. In Arrow batches: built-in patterns can't balance braces."""
    return _first_object(F.col(c) if isinstance(c, str) else c)


def score(reply: Column) -> Column:
    """``score`` of a reply's object as a whole number from -100 to 100; null if it isn't a number."""
    n = F.get_json_object(reply, "$.score").try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.greatest(F.lit(-100), F.least(F.lit(100), F.rint(n))).cast("int"))
