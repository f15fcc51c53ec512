"""Windows over bars: one ordering for each key, and frames that count only when they are full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def W():  # noqa: N802
    """A ticker's bars by date. A function, as a window specification needs a running session."""
    return Window.partitionBy("ticker").orderBy("date")


def frame(a: int, b: int):
    return W().rowsBetween(a, b)


def last_n(n: int):
    return frame(-(n - 1), 0)


def full(agg, col: Column | str, n: int, rows=None) -> Column:
    """``agg(col)`` over the last ``n`` rows (or ``rows``), null unless it holds ``n`` values."""
    rows = last_n(n) if rows is None else rows
    return F.when(F.count(col).over(rows) == n, agg(col).over(rows))


def ret(col: str | Column = "close", n: int = 1) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(c, F.lag(c, n).over(W())) - 1


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(col, digits)


def rank_in_key():
    return F.row_number().over(W())


def trailing_sums(rows: DataFrame, by: str, at: str, span: int, stretch: int = 3_600_000_000, source: DataFrame | None = None, **values: Column) -> DataFrame:
    """``rows`` with the sums of ``values`` (whole numbers) over those of their key in (at - span, at]: left open, equal times included.

    A row counts from its time on, and from ``span`` later no more, so a sum is that of all changes up to its time. Changes are summed by ``stretch`` of time first; a
    running sum stays within one and adds what the earlier ones hold. So no task holds a whole key, and no frame is read again for each of its rows.
    ``source`` has the same keys, times and values where ``rows`` are costly to derive twice.
    """

    def changes(rows: DataFrame, *row: Column) -> DataFrame:
        begin = F.struct(F.col(at).cast("long").alias("__at"), *(r.alias("__row") for r in row), *(v.cast("long").alias(k) for k, v in values.items()))
        end = F.struct((F.col(at) + span).cast("long").alias("__at"), *(F.lit(None).alias("__row") for _ in row), *((-v.cast("long")).alias(k) for k, v in values.items()))
        t = rows.select(F.col(by).alias("__by"), F.inline(F.array_compact(F.array(begin, F.when(F.col(at).isNotNull(), end)))))  # rows without a time count among themselves
        return t.withColumn("__s", F.col("__at") - F.pmod("__at", F.lit(stretch)))

    earlier = Window.partitionBy("__by").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    sizes = changes(rows if source is None else source).filter("__s is not null").groupBy("__by", "__s").agg(*(F.sum(k).alias(k) for k in values))
    sizes = sizes.select(F.col("__by").alias("__b"), F.col("__s").alias("__z"), *(F.sum(k).over(earlier).alias(f"__{k}") for k in values))
    own = Window.partitionBy("__by", "__s").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    t = changes(rows, F.struct(*rows.columns)).select("__by", "__s", "__row", *(F.sum(k).over(own).alias(k) for k in values)).filter("__row is not null")
    t = t.join(sizes, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__s") == F.col("__z")), "left")
    return t.select("__row.*", *((F.col(k) + F.coalesce(f"__{k}", F.lit(0))).alias(k) for k in values))
