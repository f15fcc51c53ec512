"""Events placed on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_to_bar(events: DataFrame, bars: DataFrame, date: str = "earnings_date", shift_rolled: bool = False) -> DataFrame:
    """``at``, ``exact`` and ``reaction``: the event's bar, the first on or after its date; after-close reports move one bar on.

    An event that already rolled to a later bar moves on only with ``shift_rolled``. Events after the last bar have null bars.
    One pass: events and bars are put in one order per ticker, latest first, and each event takes the bar last seen.
    """
    cols = events.columns
    left = events.select("ticker", F.col(date).alias("__d"), F.lit(0).alias("__k"), F.struct(*cols).alias("__row"), F.lit(None).cast("long").alias("__nth"))
    right = bars.select("ticker", F.col("date").alias("__d"), F.lit(1).alias("__k"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col("nth").cast("long").alias("__nth"))
    w = Window.partitionBy("ticker").orderBy(F.desc("__d"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(F.when(F.col("__k") == 1, F.struct(F.col("__d").alias("d"), F.col("__nth").alias("n"))), ignorenulls=True).over(w)
    t = left.unionByName(right).withColumn("__next", after).filter("__k = 0")
    t = t.select("__row.*", F.col("__next.n").alias("at"), (F.col("__next.d") == F.col("__d")).alias("exact"))
    late = (F.col("report_time") == "AMC") & (F.lit(shift_rolled) | F.col("exact"))
    return t.withColumn("reaction", F.col("at") + late.cast("int"))
