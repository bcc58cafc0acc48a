"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.llm.common import HOT_ROWS, lookup, stored


def _to_least(pairs: DataFrame) -> DataFrame:
    """``(u, v, least)``: each pair with the least node of ``u`` and its neighbours. A node with very
    many neighbours is folded on the map side, and its pairs get their ``least`` by broadcast."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count(F.lit(1)).alias("_n"))
    least = stored(least)
    if least.where(F.col("_n") > HOT_ROWS).isEmpty():
        return pairs.join(least.hint("merge"), "u").drop("_n")
    return lookup(pairs, least, "u", "_n").drop("_n")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        stars = _to_least(edges)
        own = stars.select("u", F.col("least").alias("v"))
        joined = own.unionByName(stars.select(F.col("v").alias("u"), F.col("least").alias("v"))).where("u != v")
    return stored(joined.distinct())


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``: the least node it reaches.

    Links of a node to itself, links with a null end and repeated links change nothing; without links
    the result is empty. Every round is stored, and rounds end when the links stay the same.
    """
    ends = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, before = stored(ends.distinct()), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = _star(_star(now, True), False)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
