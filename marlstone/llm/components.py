"""Connected components by alternating star contraction; every step is a join and a partial min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_apart


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return got[0], int(got[1] or 0)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Links (u, v) of comparable ids -> (node, root): root is the smallest id reachable.

    Nodes without a link to another node don't appear. Loops and repeated links are harmless; a
    null on either side is no link. Converges in O(log^2 n) rounds whatever the shape; each round is
    written to the shared folder.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u > v")
        .filter(a.isNotNull() & b.isNotNull())
        .distinct()
    )
    before = _state(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = join_apart(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_apart(large, low, ["u"])
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .filter("u > v")
            .distinct()
        )
        now = cut(small)
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
