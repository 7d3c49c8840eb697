"""Connected components of an edge table, by hash-to-minimum with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id of ``edges (a, b)``: the least id of its component.

    Each round links all neighbours of an id to the least one (large star), then every id to
    the least of its smaller neighbours (small star), until nothing changes; long chains halve.
    Every step is written to the shared folder. Groups are reduced by ``min`` before the
    shuffle, and minima are written before their join, so that Spark can split the edges of an id
    with very many neighbours.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = saved(current, "components")
    known = None
    while True:
        both = current.union(current.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least-neighbours")
        large = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        small = saved(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        linked = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = saved(linked.select("e.a", "e.b").where("a <> b").distinct(), "components")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").union(
                current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            )
        known = state
