"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import forget, hot_join, stored

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: long): root is the least node that can be reached.

    Alternates two steps until nothing changes: every node points its larger neighbours to its least neighbour, then every
    node points its smaller neighbours (and itself) to the least of them. Only least values are aggregated, never lists of
    neighbours, each round is written to the shared folder, and only a count and a checksum come to the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = hot_join(both, least, ["v"]).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = hot_join(large, least, ["v"]).select(F.col("u").alias("x"), "v", "m")
        small = small.filter("x <> m").select(F.col("x").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).filter("v <> u").distinct()
        edges, spent = stored(small, "links"), edges
        forget(spent)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
