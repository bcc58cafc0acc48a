"""Equi-join that stays balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of all rows. At most 1 / HOT_SHARE keys can be
# hot, and the salts of all hot keys together stay below 2 / HOT_SHARE.
HOT_SHARE = 0.001
HOT_MIN_ROWS = 100_000
# Rows are counted by this many hashes of their keys first; a hash has far less than HOT_SHARE of many small keys.
HASHES = 1 << 14


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """``(keys, n_salts)`` for keys above ``share`` of all rows; at most ``1 / share`` rows.

    Only the key columns are read. A key has no more rows than its hash, so rows are counted by hash first and only the
    keys of large hashes by themselves: a task sends at most ``HASHES`` rows however many keys there are, and a
    second pass reads the input only where there is such a hash. Counts are combined map-side, so a hot key
    sends one row per task. ``min_rows`` keeps small inputs free of salting.
    """
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_hash")
    by_hash = df.select(hashed).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    # Of at most HASHES rows.
    total = F.sum("_n").over(W.partitionBy(F.lit(0)))
    by_hash = by_hash.withColumn("_piece", F.greatest(total * F.lit(share), F.lit(float(min_rows))))
    large = by_hash.where(F.col("_n") > F.col("_piece")).select("_hash", "_piece")
    counts = df.select(*keys, hashed).join(F.broadcast(large), "_hash")
    counts = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("_piece").alias("_piece"))
    return (
        counts.where(F.col("_n") > F.col("_piece"))
        .select(*keys, F.ceil(F.col("_n") / F.col("_piece")).cast("int").alias("n_salts"))
    )


def local(spark: SparkSession, hot: DataFrame) -> DataFrame:
    """Hot keys as a table in the driver: they are counted once, and a join without any has no branch for them."""
    return spark.createDataFrame(hot.toArrow(), hot.schema)


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
    unique: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``keys``, spreading hot keys of ``big`` over salted pieces.

    Rows of hot keys are joined apart: ``small`` rows of a hot key are copied once per salt; rows of
    other keys are joined plainly.
    ``spread_by`` picks the piece of a ``big`` row and must be a function of the row's own values,
    so that a recomputed task sends the row to the same piece. The hot-key table is broadcast; its
    size is bounded by ``1 / share`` whatever the data. With ``unique`` the caller vouches that ``small`` has a key once.
    Its rows of hot keys are then as few and are broadcast, and it is sorted and merged, not broadcast, for the others, so
    that a bucketed ``small`` is read where it lies. ``hot`` are the hot keys where they are known already, as for one of
    several shares of ``big``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', got {how!r}")
    hot = hot_keys(big, keys, share, min_rows) if hot is None else hot
    # Everything else meets on the keys alone, so a side that is partitioned by them stays where it
    # is. All three joins read one broadcast table; without hot keys the other branch ends there.
    cold = big.join(F.broadcast(hot), list(keys), "left").where("n_salts IS NULL").drop("n_salts")
    if unique:
        merged = small.hint("merge")
        # Laid together first, else a bucketed `small` would be sent to where the hot keys lie.
        few = merged.join(hot.select(*keys).repartition(1).hint("merge"), list(keys))
        warm = big.join(F.broadcast(hot), list(keys), "left_semi").join(F.broadcast(few), list(keys), how)
        met = merged.join(cold, list(keys), "right" if how == "left" else how)
        return met.select(*keys, *[c for c in (*big.columns, *small.columns) if c not in keys]).unionByName(warm)
    cold = cold.join(small, list(keys), how)
    left = (
        big.withColumn("_spread", F.xxhash64(spread_by))
        .join(F.broadcast(hot), list(keys), "inner")
        .withColumn("_salt", F.pmod(F.col("_spread"), F.col("n_salts").cast("long")).cast("int"))
        .drop("_spread", "n_salts")
    )
    right = (
        small.join(F.broadcast(hot), list(keys), "inner")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
        .drop("n_salts")
    )
    return cold.unionByName(left.join(right, [*keys, "_salt"], how).drop("_salt"))
