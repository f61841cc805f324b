"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import stored

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``id``, ``component``): the smallest id reachable, for every id in a link.

    Alternating large-star and small-star steps: each id's larger neighbours,
    then its smaller ones, are hung on its smallest neighbour, until nothing
    changes.  The number of rounds grows with the logarithm of the longest
    chain.  A step shuffles (id, neighbour) pairs; the minimum is a partial
    aggregate and the join back is split by AQE where one id has most links.
    """
    x, y = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(links.where(F.col(a) != F.col(b)).select(x, y).distinct())     # u > v
    for _ in range(MAX_ROUNDS):
        # settled: every id hangs on one other, which hangs on none
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up > 0 and low = 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()                                  # larger neighbours to the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        edges = stored(small.where("u <> v").distinct())
    raise RuntimeError("components did not settle")
