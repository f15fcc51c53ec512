"""As-of joins in one pass: both sides are put in one order per key, and a window carries the other side's row along."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, direction: str = "backward", inclusive: bool = True, tie: str | None = None) -> DataFrame:
    """``left`` with ``match``: the struct of the nearest row of ``right`` before (or after) it, null where there is none.

    ``inclusive`` takes a row at just the same time. Of right rows at one time, backward takes the last and forward the
    first by ``tie``. One shuffle and one sort of both sides; nothing is paired.
    """
    back = direction == "backward"
    order_right = 0 if inclusive == back else 2  # before or after the left rows of the same time
    row_l, row_r = F.struct(*left.columns), F.struct(*right.columns)
    t = F.col(tie) if tie else F.lit(0)
    a = left.select(F.col(by).alias("__by"), F.col(left_time).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(right.select(t).schema[0].dataType).alias("__tie"), row_l.alias("__l"), F.lit(None).cast(right.select(row_r).schema[0].dataType).alias("__r"))
    b = right.select(F.col(by).alias("__by"), F.col(right_time).alias("__t"), F.lit(order_right).alias("__k"), t.alias("__tie"), F.lit(None).cast(left.select(row_l).schema[0].dataType).alias("__l"), row_r.alias("__r"))
    # forward is backward in the opposite order: a frame that ends with the key's last row would be read again for each row
    order = F.asc if back else F.desc
    w = Window.partitionBy("__by").orderBy(*map(order, ("__t", "__k", "__tie"))).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("match", F.last("__r", ignorenulls=True).over(w)).filter("__k = 1").select("__l.*", "match")


def bucketed_range_join(left: DataFrame, right: DataFrame, by: str, point: str, low: str, high: str, width_days: int) -> DataFrame:
    """Rows of ``left`` whose date lies in [low, high] of a row of ``right`` with the same key, by an equi join on date buckets.

    ``right`` is copied to each bucket that its range touches, so the join hashes instead of looping over pairs.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / width_days)
    r = right.withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return left.withColumn("__b", bucket(F.col(point))).join(r, [by, "__b"]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")
