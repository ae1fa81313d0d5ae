"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspan.staging import staged, unstage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node on an edge.

    ``edges`` has long columns a, b. Alternates large-star and small-star steps (Kiveris et al.,
    "Connected Components in MapReduce and Beyond"), each a grouped minimum and a join, so a hub's
    neighbours are never gathered into one row. The edge table is written to the shared folder
    between rounds.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        # Each node a sends the smallest of itself and its neighbours to its larger (or smaller) neighbours.
        pairs = both(e) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = pairs.join(least, "a")
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    mark = state(current)
    for _ in range(most_rounds):
        if mark[0]:
            before, current = current, staged(star(star(current, True), False))
            unstage(before)
            last, mark = mark, state(current)
        if not mark[0] or mark == last:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError("components did not settle")
