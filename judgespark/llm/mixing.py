"""Mixing of sources to target weights.

Sizes are words. A source's target is its weight's share of all words, held at ``MOST`` times its size; what
is over goes to the others by weight. A source's documents are dealt to blocks by a hash, and the blocks
have a permuted order. Whole passes and then a partial one draw blocks in that order, so a source has an
exact quota of draws. A splitting tree divides the quotas among output shards: each node draws the left
half's share of every source from the multivariate hypergeometric distribution, as if all draws had
been shuffled. Each shard gets its own stretch of each source's draws, and shuffles its documents.

The block with the last word of a partial pass is taken document by document in permuted order, and
the document with the last word is cut there. All choices are hashes and seeded draws, so runs agree. A
source has at most ``MAX_BLOCKS`` blocks, which bounds every window and the tree, however large it is.

A null text has no words, a null source is a source and the last one, repeated rows are mixed each, null
ids are ids, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgespark.llm.common import lookup, numbered, record, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS, MAX_BLOCKS = 1 << 16, 4096
SHARD_DRAWS = 64
SEED = 20240601


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """``rank`` from 0 by ``column``, nulls last: sorted ranges of rows, each after the rows of those before."""
    order = F.col(column).asc_nulls_last()
    parts = stored(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_offset") + inside).drop("_part", "_offset")


def with_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``target`` of each source: ``min(most * words, level * weight)``, at the level that gives all words.

    Sources leave the level for good once it is above their limit, so it is found in a few sums.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight))
    total, level = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], 0.0
    while total:
        held = F.col("words") * most <= F.col("weight") * F.lit(level)
        taken, rest = sources.agg(
            F.sum(F.when(held, F.col("words") * most).otherwise(0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))
        ).first()
        now = (total - taken) / rest if rest else level
        if now == level:
            break
        level = now
    limit = (F.col("words") * most).cast("double")
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def split_quotas(quota: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, draws before it, its draws)`` per source for the shards ``first`` to ``last``, exclusive.

    Shards have equal numbers of draws, to one. A node's draw depends on its place only, so
    whichever task walks through it gets the same one.
    """
    draws = int(quota.sum())
    bound = lambda shard: draws * shard // shards
    nodes = [(0, shards, np.zeros_like(quota), quota)]
    while nodes:
        a, b, before, own = nodes.pop()
        if b <= first or a >= last:
            continue
        if b - a == 1:
            yield a, before, own
            continue
        middle = (a + b) // 2
        rng = np.random.default_rng((seed, a, b))
        left = rng.multivariate_hypergeometric(own, bound(middle) - bound(a), method="marginals")
        nodes.append((middle, b, before + left, own - left))
        nodes.append((a, middle, before, left))


def shard_ranges(quotas: DataFrame, shard_draws: int, seed: int) -> DataFrame:
    """``(key, shard, draw)`` for every draw; ``quotas`` has ``(key, draws)``, one row a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [s["key"] for s in row["sources"]]
                quota = np.array([s["draws"] for s in row["sources"]], np.int64)
                shards = -(-int(quota.sum()) // shard_draws)
                of = lambda t: shards * t // row["tasks"]
                for shard, before, own in split_quotas(quota, shards, of(row["task"]), of(row["task"] + 1), seed):
                    some = np.flatnonzero(own)
                    at = np.repeat(before[some] - np.cumsum(own[some]) + own[some], own[some]) + np.arange(own.sum())
                    yield record(
                        {
                            "key": pa.array([keys[i] for i in np.repeat(some, own[some])], pa.string()),
                            "shard": np.full(len(at), shard, np.int64),
                            "draw": at,
                        }
                    )

    some = quotas.where("draws > 0").select("key", F.col("draws").cast("long").alias("draws"))
    root = some.agg(F.array_sort(F.collect_list(F.struct("key", "draws"))).alias("sources"))
    tasks = F.least(F.lit(64), F.ceil(F.aggregate("sources", F.lit(0).cast("long"), lambda s, x: s + x["draws"]) / shard_draws))
    root = root.where(F.size("sources") > 0).withColumn("tasks", tasks.cast("int"))
    dealt = root.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).repartition("task")
    return dealt.mapInArrow(run, "key string, shard long, draw long")


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
    shard_draws: int = SHARD_DRAWS, seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs`` (a stored table): ``_row, doc_id, size, source_size, target, taken`` and ``copies``,
    an array of ``(pass, shard, words)``."""
    hashed = lambda *c: F.xxhash64(F.lit(seed), *c)
    rows = numbered(docs).select(
        "_row",
        "doc_id",
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("key"),
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = stored(rows)
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    sources = with_targets(ranked(sources, "source"), weights, most)
    quota = F.round("target").cast("long")
    sources = stored(
        sources.select(
            "key", "rows", "words", "target",
            F.when(F.col("words") > 0, F.floor(quota / F.col("words"))).otherwise(0).cast("int").alias("passes"),
            F.when(F.col("words") > 0, quota % F.col("words")).otherwise(0).alias("rest"),
            F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("words") / block_words))).cast("int").alias("n_blocks"),
        )
    )
    rows = lookup(rows.drop("source"), sources, "key", "rows").drop("rows")
    rows = stored(rows.withColumn("block", F.pmod(hashed("doc_id"), F.col("n_blocks").cast("long")).cast("int")))

    # Blocks in permuted order; the partial pass draws them until it has its words.
    blocks = rows.groupBy("key", "block").agg(
        F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("passes").alias("passes")
    )
    order = Window.partitionBy("key").orderBy(hashed("key", "block"), "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"nth": F.row_number().over(order) - 1, "left": F.col("rest") - before})
    blocks = blocks.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("key")))
    blocks = stored(blocks.withColumn("drawn", F.col("passes") + (F.col("left") > 0).cast("int")))
    quotas = blocks.groupBy("key").agg(F.sum("drawn").alias("draws"))
    draws = blocks.where("drawn > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1)))
    draws = draws.withColumn("draw", (F.col("pass") * F.col("held") + F.col("nth")).cast("long"))
    shards = draws.select("key", "block", "pass", "draw").join(shard_ranges(quotas, shard_draws, seed), ["key", "draw"])
    shards = shards.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    plan = stored(blocks.select("key", "block", "left", F.col("size").alias("block_size")).join(shards, ["key", "block"], "left"))

    # In the block with the last word, documents in permuted order; at most one such block a source.
    rows = rows.join(plan.hint("merge"), ["key", "block"])
    cut = (F.col("left") > 0) & (F.col("left") < F.col("block_size"))
    inside = Window.partitionBy("key").orderBy(hashed("doc_id", "size"), "_row")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    partial = rows.where(cut).withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - upto + F.col("size"))))
    whole = rows.where(~cut).withColumn("part", F.when(F.col("left") > 0, F.col("size")).otherwise(0))
    out = partial.unionByName(whole)
    words = lambda s: F.when(s["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part"))
    copies = F.transform(
        F.coalesce("shards", F.array().cast("array<struct<pass:int,shard:bigint>>")),
        lambda s: F.struct(s["pass"].alias("pass"), s["shard"].alias("shard"), words(s).alias("words")),
    )
    out = out.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return out.select("_row", "doc_id", "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs`` with ``_shard`` and ``_place``, one row a copy, shuffled in its
    shard by ``_place``. A cut copy keeps the words it takes, joined by one space."""
    seed = options.get("seed", SEED)
    plan = mixture(docs, **options).select("_row", "size", F.explode("copies").alias("c"))
    plan = plan.select(
        "_row", F.col("c.shard").alias("_shard"), F.col("c.words").alias("_words"), F.col("size").alias("_size"),
        F.xxhash64(F.lit(seed), "c.shard", "_row", "c.pass").alias("_place"),
    )
    rows = numbered(docs).join(plan, "_row")
    held = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    kept = F.array_join(F.slice(held, F.lit(1), F.col("_words").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_words") < F.col("_size"), kept).otherwise(F.col("text")))
    rows = rows.select(*docs.columns, "_shard", "_place")
    return rows.repartition("_shard").sortWithinPartitions("_shard", "_place")
