"""Statistics of scores and outcomes, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(panel: DataFrame, xs: tuple[str, ...], ys: tuple[str, ...]) -> DataFrame:
    """ticker, date, xname, x, yname, y: every score with every outcome, where both are known."""
    named = lambda names, a, b: F.explode(F.array(*(F.struct(F.lit(n).alias(a), F.col(n).alias(b)) for n in names)))
    t = panel.withColumn("__x", named(xs, "xname", "x")).withColumn("__y", named(ys, "yname", "y"))
    return t.select("ticker", "date", "__x.*", "__y.*").filter("x is not null and y is not null")


def _in_ranges(rows: DataFrame, col: str, by: list[str], aggregates: tuple[Column, ...], buckets: int) -> tuple[DataFrame, DataFrame]:
    """by..., ``col``, n and ``aggregates`` of every different value, with the range that it is in, between approximate quantiles of its group; and by...,
    __range, __n, __before, __total: how many rows a range, those before it and the group have."""
    some = rows.filter(F.col(col).isNotNull())
    g = some.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    cuts = some.groupBy(*by).agg(F.percentile_approx(col, [k / buckets for k in range(1, buckets)], 10_000).alias("__cuts"))
    g = g.join(cuts, by) if by else g.join(F.broadcast(cuts))  # without groups, it is one row
    g = g.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(col)))).drop("__cuts")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a group has at most ``buckets`` rows here
    sizes = g.groupBy(*by, "__range").agg(F.sum("n").alias("__n"))
    return g, sizes.select(*by, "__range", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__total"))


def ranked_values(rows: DataFrame, col: str, by: list[str], *aggregates: Column, buckets: int = 256) -> DataFrame:
    """by..., ``col``, n, rank and ``aggregates`` of every different value of ``col``: rank with ties at their mean. Nulls have no rank.

    Equal values are counted first; values are then dealt to ranges between approximate quantiles of their group, numbered within a
    range, and moved up by what the ranges before hold. So no task sorts a whole group, be there ever so few groups.
    """
    g, sizes = _in_ranges(rows, col, by, aggregates, buckets)
    own = Window.partitionBy(*by, "__range").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("__before") + F.sum("n").over(own) - F.col("n") + (F.col("n") + 1) / 2.0
    return g.join(sizes.drop("__n", "__total"), [*by, "__range"]).withColumn("rank", rank).drop("__range", "__before")


def quantiles(rows: DataFrame, col: str, by: list[str], upper: bool = False, buckets: int = 256, **shares: float) -> DataFrame:
    """by... and a column for each of ``shares``: the exact quantile of ``col``, between two values in proportion, or with ``upper`` the upper of the two.
    Groups without a value have no row.

    Ranges of values are counted, and only those that hold a wanted place are sorted. So no task holds a whole group, as an exact ``percentile`` would.
    """
    g, sizes = _in_ranges(rows, col, by, (), buckets)
    # places count from 0; half a step more than a whole number must not be lost to rounding
    place = lambda p: F.col("__total") * p if upper else (F.col("__total") - 1) * p
    first = lambda p: F.floor(place(p)).cast("long")
    last = lambda p: first(p) if upper else F.ceil(place(p)).cast("long")
    held = F.lit(False)
    for p in shares.values():
        held = held | ((F.col("__before") <= last(p)) & (F.col("__before") + F.col("__n") > first(p)))
    own = Window.partitionBy(*by, "__range").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    near = g.join(sizes.filter(held), [*by, "__range"]).withColumn("__end", F.col("__before") + F.sum("n").over(own)).withColumn("__start", F.col("__end") - F.col("n"))
    at = lambda k: F.max(F.when((F.col("__start") <= k) & (F.col("__end") > k), F.col(col)))
    out = []
    for name, p in shares.items():
        part = F.max(place(p) - first(p))
        out.append((at(first(p)) if upper else at(first(p)) + (at(last(p)) - at(first(p))) * part).alias(name))
    return near.groupBy(*by).agg(*out)


def spearman(long: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, rho."""
    t = long
    for c in ("x", "y"):
        t = t.join(ranked_values(long, c, by).select(*by, c, F.col("rank").alias(f"r{c}")), [*by, c])
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation: the tail of Student's t by the continued fraction of the incomplete beta."""

    @F.pandas_udf("double")
    def tail(r, n):
        import math

        import pandas as pd

        def one(r, n):
            if n is None or n < 3 or r is None or r != r:
                return None
            if r == 0 or abs(r) >= 1:
                return float(r == 0)
            a, b, x = (n - 2) / 2, 0.5, 1 - r * r
            front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
            swap = x >= (a + 1) / (a + b + 2)
            p, q, z = (b, a, 1 - x) if swap else (a, b, x)
            c, d = 1.0, 1 / max(1 - (p + q) * z / (p + 1), 1e-300)
            f = d
            for m in range(1, 300):
                k = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
                d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
                f *= d * c
                k = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
                d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
                f *= d * c
                if abs(d * c - 1) < 1e-14:
                    break
            i = front * f / p if 0 < x < 1 else float(x >= 1)
            return 1 - i if swap else i

        return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")

    return tail(r.cast("double"), n.cast("double"))


def first_rows(rows: DataFrame, bucket: Column, order: list[Column], limit: DataFrame) -> DataFrame:
    """The first rows by ``bucket`` (a number of few values) and then ``order``, as many as ``limit`` (one row, one column) says.

    Buckets are counted; those before the cut are taken whole, and only the rows of the bucket that the cut falls into are numbered.
    """
    counts = rows.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per bucket
    plan = counts.withColumn("__before", before).join(F.broadcast(limit.select(F.col(limit.columns[0]).alias("__limit"))))
    plan = plan.filter("__before < __limit")
    t = rows.withColumn("__b", bucket).join(F.broadcast(plan), "__b")
    whole = F.col("__before") + F.col("__n") <= F.col("__limit")
    cut = t.filter(~whole).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order))).filter("__r <= __limit - __before")
    return t.filter(whole).select(*rows.columns).unionByName(cut.select(*rows.columns))


def top_rows(scored: DataFrame, score: str, pct: float, keys: tuple[str, ...] = ("ticker", "date"), buckets: int = 256) -> DataFrame:
    """The best ``pct`` percent by score (at least one), ties by key; nulls last."""
    limit = scored.agg(F.greatest(F.floor(F.count(F.lit(1)) * pct / 100), F.lit(1)).alias("k"))
    cuts = scored.agg(F.percentile_approx(score, [k / buckets for k in range(1, buckets)], 10_000).alias("__cuts"))
    t = scored.join(F.broadcast(cuts))
    bucket = F.when(F.col(score).isNull(), buckets).otherwise(F.size(F.filter("__cuts", lambda c: c > F.col(score))))
    return first_rows(t, bucket, [F.desc_nulls_last(score), *map(F.col, keys)], limit).drop("__cuts")


def lift(scored: DataFrame, score: str, label: str, pct: float) -> DataFrame:
    """precision_, base_rate, lift of the best ``pct`` percent."""
    base = scored.agg(F.avg(label).alias("base_rate"))
    best = top_rows(scored, score, pct).agg(F.avg(label).alias("precision_"))
    return best.join(F.broadcast(base)).select("precision_", "base_rate", F.try_divide("precision_", "base_rate").alias("lift"))


def auc(scored: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """by..., auc: from tie-averaged ranks; null without both labels. Rows without a score are left out."""
    g = ranked_values(scored, score, by, F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    pos, neg = F.sum("pos"), F.sum("neg")
    return g.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2.0, pos * neg).alias("auc"))


def _drawn(numbered: DataFrame, draws: int) -> DataFrame:
    """draw, __i: each place of each draw with the number that it takes. The places (``numbered`` by __i, from 0) are few rows that become many: they are dealt out first."""
    total = numbered.agg(F.count(F.lit(1)).alias("__t"))
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = numbered.select(F.col("__i").alias("__slot")).repartition(tasks, "__slot").join(F.broadcast(total)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    number = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit("-"), F.col("__slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return slots.select("draw", (number % F.col("__t")).alias("__i"))


def _numbered(clusters: DataFrame, cluster: str) -> DataFrame:
    return ranked_values(clusters.select(cluster).distinct(), cluster, []).select(cluster, (F.col("rank") - 1).cast("long").alias("__i"))


def cluster_draws(clusters: DataFrame, cluster: str, draws: int) -> DataFrame:
    """draw, ``cluster`` (a number), w: how often each cluster is drawn when as many as there are get drawn with replacement, ``draws`` times.

    Each place of a draw takes the cluster whose number (by order, from 0) a hash of draw and place gives, so the counts of a draw add up to the number of clusters.
    """
    numbered = _numbered(clusters, cluster)
    w = _drawn(numbered, draws).groupBy("draw", "__i").agg(F.count(F.lit(1)).alias("w"))
    return w.join(numbered, "__i").select("draw", cluster, "w")


def bootstrap_corr(panel: DataFrame, cluster: str, x: str, y: str, draws: int) -> DataFrame:
    """draws, low, high: the middle 95 % of correlations when clusters are drawn again; draws without a correlation are left out.

    Rows are read once for sums per cluster; what is drawn meets those and is summed by draw, so that no task holds draws x clusters.
    """
    s = panel.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(k) for k, e in (("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) ** 2), ("syy", F.col(y) ** 2), ("sxy", F.col(x) * F.col(y)))))
    numbered = _numbered(s, cluster)
    d = _drawn(numbered, draws).join(s.join(numbered, cluster).drop(cluster).hint("shuffle_hash"), "__i")
    t = d.groupBy("draw").agg(*(F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    r = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)))
    return t.select(r.alias("r")).filter("r is not null and not isnan(r)").agg(F.count(F.lit(1)).alias("draws"), F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))  # a row per draw


def classification(rows: DataFrame, predicted: str, label: str, by: list[str]) -> DataFrame:
    """by..., n, f1, accuracy; 0 where F1 divides by zero."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    tp, fp, fn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.avg((F.col(predicted) == F.col(label)).cast("int")).alias("accuracy"))


def sharpe(ret: str, periods: float) -> Column:
    sd = F.stddev_samp(ret)
    return F.when((F.count(ret) < 2) | (F.coalesce(sd, F.lit(0.0)) == 0), 0.0).otherwise(F.try_divide(F.avg(ret), sd) * periods**0.5)
