"""Pieces of SQL text for the DuckDB side of the registered queries."""

from __future__ import annotations

BY = "PARTITION BY ticker ORDER BY date"


def over(a: int | str, b: int | str, by: str = BY) -> str:
    side = lambda k, word: "CURRENT ROW" if k == 0 else f"UNBOUNDED {word}" if isinstance(k, str) else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({by} ROWS BETWEEN {side(a, 'PRECEDING')} AND {side(b, 'FOLLOWING')})"


def full(agg: str, col: str, n: int, rows: str | None = None) -> str:
    rows = rows or over(-(n - 1), 0)
    return f"CASE WHEN count({col}) OVER {rows} = {n} THEN {agg}({col}) OVER {rows} END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER ({BY})"


BASICS = f"b AS (SELECT *, close - prev_close AS change, close / prev_close - 1 AS ret_1, close * volume AS dollar FROM (SELECT *, row_number() OVER ({BY}) AS nth, lag(close) OVER ({BY}) AS prev_close FROM bars) AS x)"
