"""Forward outcomes: what happened after a row. Never an input of a feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators.windows import W, frame


def forward_by_time(ticks: DataFrame, horizon: int, tolerance: int) -> DataFrame:
    """``later``: the first price at or after us + horizon, at most ``tolerance`` later, else null. A range frame, no join."""
    w = Window.partitionBy("ticker").orderBy("us").rangeBetween(horizon, horizon + tolerance)
    return ticks.withColumn("later", F.first("price").over(w))


def forward_max_multiple(n: int) -> Column:
    """Highest high of the next n bars over the close; null unless at least n - 1 bars remain."""
    w = frame(1, n)
    return F.when(F.count("high").over(w) >= n - 1, F.max("high").over(w) / F.col("close"))


def cut_archive(bars: DataFrame, day: str = "1998-06-30") -> DataFrame:
    """The archive with every eighth ticker ending early."""
    return bars.filter(~((F.col("ticker") % 8 == 7) & (F.col("date") > F.lit(day).cast("date"))))


def delisted(bars: DataFrame, days: int) -> DataFrame:
    """ticker, last_date, delisted: whether its last bar lies more than ``days`` before the archive's end."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    end = last.agg(F.max("last_date").alias("end_date"))
    return last.join(F.broadcast(end)).select("ticker", "last_date", (F.col("last_date") < F.date_sub("end_date", days)).alias("delisted"))


def excess(rows: DataFrame, benchmark: DataFrame, ret: str, bench: str) -> DataFrame:
    """``excess`` and ``relative_pct`` over the benchmark's return of the same date."""
    j = rows.join(benchmark, "date")
    return j.withColumns({"excess": F.col(ret) - F.col(bench), "relative_pct": 100 * ((1 + F.col(ret)) / (1 + F.col(bench)) - 1)})


def path_join(picks: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Each pick (ticker, entry, base) with its next ``n`` bars and their distance k; an equi join on blocks of n bars."""
    b = bars.select(F.col("ticker").alias("tk"), F.row_number().over(W()).alias("nth"), "date", "open", "high", "low", "close").withColumn("blk", F.floor(F.col("nth") / n))
    p = picks.withColumn("blk", F.explode(F.sequence(F.floor((F.col("entry") + 1) / n), F.floor((F.col("entry") + n) / n))))
    j = p.join(b, (p["ticker"] == b["tk"]) & (p["blk"] == b["blk"])).filter((F.col("nth") > F.col("entry")) & (F.col("nth") <= F.col("entry") + n))
    return j.select("ticker", "entry", "base", (F.col("nth") - F.col("entry")).alias("k"), "date", "open", "high", "low", "close")


#: Bars of a block in which a first touch is looked for.
TOUCH_BLOCK = 16


def barrier_outcome(picks: DataFrame, bars: DataFrame, target: float, stop: float, n: int, haircut: float = 1.0, short: str = "short", block: int = TOUCH_BLOCK) -> DataFrame:
    """ticker, entry, outcome, ret, held: the first bar that reaches the stop (looked at first) or the target, at the barrier
    or the open beyond it; else the last close, times ``haircut`` and named ``short`` where fewer than n bars follow. Picks without a bar behind them have no row.

    A pick meets one row with the blocks of bars that it can reach: a block's lowest low and highest high tell whether a barrier can have been touched in it, and only
    then are its bars gone through, up to the first block with a touch.
    """
    b = bars.select("ticker", F.row_number().over(W()).cast("long").alias("nth"), "open", "high", "low", "close")
    blocks = b.groupBy(F.col("ticker").alias("tk"), F.floor(F.col("nth") / block).alias("b")).agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.array_sort(F.collect_list(F.struct("nth", "open", "high", "low", "close"))).alias("path"))
    reach = (n + block - 1) // block
    ahead = blocks.withColumn("at", F.explode(F.sequence(F.col("b") - reach, F.col("b")))).groupBy("tk", "at").agg(F.array_sort(F.collect_list(F.struct("b", "lowest", "highest", "path"))).alias("ahead"))
    p = picks.select("ticker", "entry", "base").distinct().withColumns({"floor": F.col("base") * (1 - stop), "ceiling": F.col("base") * (1 + target)})
    j = p.join(ahead, (F.col("ticker") == F.col("tk")) & (F.floor(F.col("entry") / block) == F.col("at")))
    within = lambda x: (x["nth"] > F.col("entry")) & (x["nth"] <= F.col("entry") + n)
    bar = F.lit(None).cast(blocks.schema["path"].dataType.elementType)
    reached = lambda low, high: (low <= F.col("floor")) | (high >= F.col("ceiling"))

    def result(k: Column, outcome: Column, price: Column) -> Column:
        return F.struct(k.alias("held"), outcome.alias("outcome"), (price / F.col("base") - 1).alias("ret"))

    def touch(x: Column) -> Column:
        stopped = x["low"] <= F.col("floor")
        price = F.when(stopped, F.least("floor", x["open"])).otherwise(F.greatest("ceiling", x["open"]))
        return F.when(x.isNotNull(), result(x["nth"] - F.col("entry"), F.when(stopped, "stop").otherwise("target"), price))

    def end(x: Column) -> Column:
        ended = x["nth"] - F.col("entry") < n
        return F.when(x.isNotNull(), result(x["nth"] - F.col("entry"), F.when(ended, short).otherwise("timeout"), x["close"] * F.when(ended, haircut).otherwise(1.0)))

    first = F.aggregate("ahead", bar, lambda acc, x: F.when(acc.isNotNull(), acc).when(reached(x["lowest"], x["highest"]), F.get(F.filter(x["path"], lambda y: within(y) & reached(y["low"], y["high"])), F.lit(0))), touch)
    newest = F.aggregate("ahead", bar, lambda acc, x: F.coalesce(F.try_element_at(F.filter(x["path"], within), F.lit(-1)), acc), end)
    return j.select("ticker", "entry", F.inline(F.array_compact(F.array(F.coalesce(first, newest))))).select("ticker", "entry", "outcome", "ret", "held")


def best_run(bars: DataFrame, n: int, cross: float, min_base: float) -> DataFrame:
    """Per ticker the start with the largest close of the next n bars over its own (ties: earliest), its peak, and when it first passed ``cross`` times the start."""
    t = bars.withColumns({"nth": F.row_number().over(W()), "multiple": F.max("close").over(frame(1, n)) / F.col("close")}).filter((F.col("close") >= min_base) & F.col("multiple").isNotNull())
    pick = t.groupBy("ticker").agg(F.max_by(F.struct("date", "nth", "close", "multiple"), F.struct(F.round("multiple", 9).alias("m"), (-F.col("nth")).alias("k"))).alias("s"))
    picks = pick.select("ticker", F.col("s.nth").alias("entry"), F.col("s.close").alias("base"))
    ratio = F.col("close") / F.col("base")
    path = path_join(picks, bars, n).groupBy("ticker").agg(F.min_by("date", F.struct((-F.round(ratio, 9)).alias("r"), "k")).alias("peak_date"), F.min(F.when(ratio >= cross, F.col("date"))).alias("cross_date"))
    return pick.join(path, "ticker").select("ticker", F.col("s.date").alias("start_date"), F.col("s.multiple").alias("multiple"), "peak_date", "cross_date")


def spaced_by_time(ticks: DataFrame, gap: int) -> DataFrame:
    """ticker, us: decision points, greedily the first at least ``gap`` after the last. The choice depends on all before it, so
    each ticker's sorted times stream through one task in Arrow batches, never held whole."""
    import pyarrow as pa

    def run(batches):
        key, last = None, 0
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key or t >= last + gap:
                    key, last = k, t
                    out.append((k, t))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["ticker", "us"])

    return ticks.select("ticker", "us").repartition("ticker").sortWithinPartitions("ticker", "us").mapInArrow(run, "ticker long, us long")
