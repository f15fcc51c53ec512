"""Column expressions over text and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_number(c: Column) -> Column:
    """A number out of text with commas, dollar and percent signs; null where it isn't one."""
    return F.regexp_replace(F.trim(c), r"[,$%\s]", "").try_cast("double")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def quarter_ordinal(label: Column) -> Column:
    """YYYYQn as year * 4 + quarter; null for other text."""
    return F.when(label.rlike(r"^\d{4}Q[1-4]$"), F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int"))


def next_quarter(label: Column) -> Column:
    q = F.substring(label, 6, 1).cast("int")
    y = F.substring(label, 1, 4).cast("int") + (q == 4).cast("int")
    return F.concat(y.cast("string"), F.lit("Q"), (q % 4 + 1).cast("string"))


def nearest_stage_below(c: Column, allowed: tuple[int, ...]) -> Column:
    """The largest allowed stage at or below; null where there is none."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, sorted(allowed))), lambda s: s <= c), F.lit(-1))


def report_time(ts: Column) -> Column:
    return F.when(F.hour(ts) >= 12, "AMC").otherwise("BMO")


def html_text(c: Column, cell: str = " | ") -> Column:
    """Text of HTML: scripts and styles dropped, cells and blocks broken, tags stripped, common entities decoded, blanks collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?i)</t[dh]>", cell)
    c = F.regexp_replace(c, r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r" ?\n[ \n]*", "\n"))
