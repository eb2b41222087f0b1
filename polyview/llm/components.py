"""Connected components of an edge table, without any part of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyview.session import stored

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest path: never reached by a graph that fits a disk


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node, root``: every node of an edge and the least node that it reaches.

    Alternates large-star (each larger neighbour is linked to the least one) and
    small-star (each smaller neighbour, too) until the edges stay the same.  Every
    round is written to the shared folder, so that a lost executor costs one
    round.  A star's centre is summed up by partial minima and then joined, so
    that an adaptive join can split it.
    """
    now = stored(
        edges.select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == before or not digest[0]:
            break
        before = digest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
