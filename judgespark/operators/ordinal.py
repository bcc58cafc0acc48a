"""Order-dependent operations without a single global task: ranks, digests, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGEST_FANOUT = 1000
_DIGEST_LEVELS = 7  # fanout ** 7 exceeds every BIGINT position
_BLOCKS, _BLOCK_ROWS, _DRAWS = 4096, 1 << 16, 8
_MANTISSA, _PARTS = 1 << 15, 1 << 18


def _block(bounds: Column, key: Column, blocks: int) -> Column:
    """How many of the sorted ``bounds`` lie below ``key``, by halving."""
    halves = F.array(*[F.lit(1 << i) for i in range(blocks.bit_length() - 1, -1, -1)])
    past = lambda at, step: (at + step <= F.size(bounds)) & (F.try_element_at(bounds, at + step) < key)
    return F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(past(at, step), step).otherwise(0))


def dense_ordinal(df: DataFrame, order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``, columns of any sortable type.

    Rows are ranked inside blocks of some 65,536, 4,096 at most, and block offsets come from a running sum over one
    count per block. Blocks are cut at rows of a sample, drawn once and then part of the plan, so a
    recomputed task puts every row where it was. They hold about equally many rows whatever the values
    are; only rows that agree on all of ``order`` share one in any case. ``rows``, if known, saves a count.
    """
    keys = df.select(*order)
    n = keys.count() if rows is None else rows
    blocks = min(_BLOCKS, -(-n // _BLOCK_ROWS))
    if blocks <= 1:
        return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    drawn = keys.sample(min(1.0, _DRAWS * blocks / n), seed=1).orderBy(*order).collect()
    cuts = [drawn[i * len(drawn) // blocks] for i in range(1, blocks)] if drawn else []
    held = df.sparkSession.createDataFrame(cuts, keys.schema)
    bounds = held.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("b")).scalar()
    blocked = df.withColumn("_bounds", bounds).withColumn("_block", _block(F.col("_bounds"), F.struct(*order), blocks)).drop("_bounds")
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_block").orderBy(*order))
    return (
        blocked.withColumn("_rank", inside)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_block", "_rank", "_offset")
    )


def digest_nodes(children: DataFrame, fanout: int, leaf: bool, keep_from: int | None = None) -> DataFrame:
    """The parents of the nodes ``(pos, line)`` of one level, as ``(pos, line)``; see :func:`tree_digest`.

    With ``keep_from``, parents from that position on also have their ``children``, others null there.
    """
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = F.sha2(F.array_join(F.transform(held, lambda x: x["line"]), "\n"), 256)
    digest = joined if leaf else F.when(F.count(F.lit(1)) == 1, F.max("line")).otherwise(joined)
    node = F.floor(F.col("pos") / fanout).alias("_node")
    kept = [] if keep_from is None else [F.when(F.first("pos") >= keep_from * fanout, held).alias("children")]
    nodes = children.groupBy(node).agg(digest.alias("line"), *kept)
    return nodes.select(F.col("_node").alias("pos"), "line", *(["children"] if kept else []))


def tree_digest(df: DataFrame, index: str, text: str, fanout: int = DIGEST_FANOUT, rows: int | None = None) -> DataFrame:
    """SHA-256 over ``text`` in ``index`` order as a tree with ``fanout`` children per node.

    ``index`` holds dense positions from 0 (see :func:`dense_ordinal`). A node hashes its children's
    lines joined by line breaks; a node above the leaves with one child passes its digest on. There are
    levels enough for every BIGINT position, or, with their number known, for ``rows``: more would
    only pass the root on. Returns one row ``digest``.
    """
    level = digest_nodes(df.select(F.col(index).alias("pos"), F.col(text).alias("line")), fanout, leaf=True)
    levels = _DIGEST_LEVELS
    if rows is not None:
        levels = next(i for i in range(1, 65) if fanout**i >= rows)
    for _ in range(levels - 1):
        level = digest_nodes(level, fanout, leaf=False)
    return level.agg(F.coalesce(F.max("line"), F.sha2(F.lit(""), 256)).alias("digest"))


def exact_percentiles(df: DataFrame, value: Column, fractions: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles of all rows as one row; 0.0 for empty input.

    Three passes. The first counts values by sign, binary exponent and 15 bits of the mantissa, which
    separates values of any scale; the second counts 2**18 parts of the buckets that hold a wanted rank;
    the third counts the values in the wanted parts, of which 2**19 can differ.
    """
    values = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    size = F.abs("v")
    exponent = F.when(F.col("v") != 0, F.floor(F.log2(size))).otherwise(0)
    scaled = values.select("v", F.signum("v").alias("sign"), exponent.alias("e"))
    mantissa = F.when(F.col("v") != 0, F.floor(size / F.pow(F.lit(2.0), F.col("e")) * _MANTISSA)).otherwise(0)
    counted = scaled.groupBy("sign", "e", mantissa.alias("m")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    everything = W.orderBy("low").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = counted.select("c", "low", "high", F.sum("c").over(everything).alias("n"))
    # Both neighbours of every fractional rank; equal when the rank is whole.
    wanted = ", ".join(
        f"struct('{name}' AS name, {side} AS side, {round_}({f}D * (n - 1)) AS rank)"
        for name, f in fractions.items()
        for side, round_ in ((0, "floor"), (1, "ceil"))
    )
    ranked = counted.withColumn("upto", F.sum("c").over(W.orderBy("low")))
    targets = ranked.selectExpr("*", f"inline(array({wanted}))")
    columns = ["name", "side", "rank", "low", "high", "n"]

    def holding(ranked: DataFrame) -> DataFrame:
        inside = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))
        return ranked.where(inside).withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c"))).select(*columns)

    def counted_in(targets: DataFrame, parts: int | None) -> DataFrame:
        # At most two targets per fraction: an array beside each value instead of a join.
        held = targets.agg(F.collect_list(F.struct(*columns)).alias("t")).scalar()
        found = values.withColumn("_t", held).select(
            "v", F.explode(F.filter("_t", lambda t: (F.col("v") >= t["low"]) & (F.col("v") <= t["high"]))).alias("t")
        ).select("v", "t.name", "t.side", "t.rank", "t.low", "t.high", "t.n")
        width = F.col("high") - F.col("low")
        part = F.when(width > 0, F.floor((F.col("v") - F.col("low")) / width * (parts - 1))) if parts else F.col("v")
        counted = found.groupBy("name", "side", "rank", "n", F.coalesce(part, F.lit(0)).alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        return counted.withColumn("upto", F.sum("c").over(W.partitionBy("name", "side").orderBy("low")))

    picked = holding(counted_in(holding(counted_in(holding(targets), _PARTS)), None))

    def interpolated(name: str, fraction: float) -> Column:
        position = F.lit(fraction) * (F.max("n") - 1)
        share = position - F.floor(position)
        low = F.max(F.when((F.col("name") == name) & (F.col("side") == 0), F.col("low")))
        high = F.max(F.when((F.col("name") == name) & (F.col("side") == 1), F.col("low")))
        return F.coalesce(low + (high - low) * share, F.lit(0.0)).alias(name)

    return picked.agg(*[interpolated(n, f) for n, f in fractions.items()])
