"""Whole documents in as few context windows as possible, by a grouping genetic algorithm on islands.

A document longer than a window is cut into windows, the first piece taking what is left over; full pieces are
windows of their own. All other pieces are dealt to shards of bounded size by a hash of their place, and each
shard is a packing problem whose solutions, lists of bins, evolve:

* a first population is best-fit packed, in decreasing order and in shuffled ones;
* crossover injects whole bins of one parent, drawn from its fullest, into the other; bins there that share a
  document with them are removed, and the documents displaced by that are best-fit again, longest first;
* mutation empties a solution's least filled bins, and some others, and best-fits what they held;
* a solution is better with fewer bins, or as many whose squared loads sum to more.

Every shard has several islands, each a row of its own with its own population. Spark evolves all
rows for an epoch, stores them, and sends each island's elite to the next island of its shard, where they
replace the worst. A shard is done when a solution has no more bins than its tokens need, since then none has
fewer, or after the last epoch. Work is seeded by shard, island and epoch, so a recomputed task
gives the same bins.

Shards do not share windows, so each can leave one window part empty, of the many it holds. Null texts count as
empty (one end token), each row is packed, repeated rows too, rows without id keep it null, an empty
table gives no rows, other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.llm.byte_tokens import Encoder
from judgespark.llm.common import record, steps, stored, text_of

WINDOW = 2048
SHARD_PIECES = 8192
ISLANDS, EPOCHS = 3, 3
POPULATION, GENERATIONS, ELITE = 4, 5, 1

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"

Bins = list[tuple[int, ...]]  # the items of each bin


class Problem:
    """Items by their sizes, and solutions as lists of bins."""

    def __init__(self, sizes: list[int], window: int):
        self.sizes, self.window = sizes, window
        self.least = -(-sum(sizes) // window)

    def load(self, items: tuple[int, ...]) -> int:
        sizes = self.sizes
        return sum([sizes[i] for i in items])

    def quality(self, bins: Bins) -> tuple[int, int]:
        """Less is better."""
        return len(bins), -sum([self.load(b) ** 2 for b in bins])

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """``bins`` with ``items`` added in their order, each where the least room stays, else in a new bin."""
        sizes, out = self.sizes, [list(b) for b in bins]
        room: dict[int, list[int]] = {}  # bins by free room
        some = 0  # bit r is set if a bin has room r
        for at, b in enumerate(out):
            free = self.window - self.load(b)
            room.setdefault(free, []).append(at)
            some |= 1 << free
        for i in items:
            size = sizes[i]
            fits = some >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                held = room[free]
                at = held.pop()
                if not held:
                    some ^= 1 << free
                out[at].append(i)
            else:
                free, at = self.window, len(out)
                out.append([i])
            free -= size
            room.setdefault(free, []).append(at)
            some |= 1 << free
        return [tuple(b) for b in out]

    def descending(self, items) -> list[int]:
        return sorted(items, key=lambda i: (-self.sizes[i], i))

    def first(self, count: int, rng: random.Random) -> list[Bins]:
        order = self.descending(range(len(self.sizes)))
        out = [self.best_fit([], order)]
        while len(out) < count and len(out[0]) > self.least:
            # Shuffled within stretches of the decreasing order, of another length each time.
            stretch, mixed = max(2, len(order) >> len(out)), []
            for a in range(0, len(order), stretch):
                part = order[a : a + stretch]
                rng.shuffle(part)
                mixed += part
            out.append(self.best_fit([], mixed))
        return out

    def crossover(self, into: Bins, giver: Bins, rng: random.Random) -> Bins:
        """``into`` with some of the fullest bins of ``giver``."""
        full = sorted(giver, key=lambda b: (-self.load(b), b))[: max(1, len(giver) // 2)]
        injected = rng.sample(full, max(1, len(full) // 3))
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in into:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in taken]
        return self.best_fit(kept + injected, self.descending(displaced))

    def mutate(self, bins: Bins, rng: random.Random) -> Bins:
        by_load = sorted(bins, key=lambda b: (self.load(b), b))
        few = max(1, len(bins) // 50)
        emptied = by_load[:few] + rng.sample(by_load[few:], min(2 * few, len(by_load) - few))
        gone = set(emptied)
        return self.best_fit([b for b in bins if b not in gone], self.descending([i for b in emptied for i in b]))

    def evolve(self, population: list[Bins], size: int, generations: int, rng: random.Random) -> list[Bins]:
        """The best ``size`` solutions after some generations, best first."""
        ranked = sorted(population, key=self.quality)[:size]
        for _ in range(generations):
            if len(ranked[0]) <= self.least:
                break
            children = []
            for _ in range(size):
                into, giver = rng.sample(ranked, 2) if len(ranked) > 1 else ranked * 2
                child = self.crossover(into, giver, rng)
                children.append(self.mutate(child, rng) if rng.random() < 0.5 else child)
            fresh = {}
            for bins in ranked + children:
                fresh.setdefault(self.quality(bins), bins)
            ranked = [fresh[q] for q in sorted(fresh)[:size]]
        return ranked


def coded(bins: Bins, n: int) -> bytes:
    """The bin of each item."""
    out = np.empty(n, np.int32)
    for at, b in enumerate(bins):
        out[list(b)] = at
    return out.tobytes()


def decoded(held: bytes) -> Bins:
    bin_of = np.frombuffer(held, np.int32)
    order = np.argsort(bin_of, kind="stable")
    return [tuple(b.tolist()) for b in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)] if len(order) else []


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """One row per piece; ``item`` numbers the pieces of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = Encoder.of(tokenizer, end_id), TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for rows, data, offsets in steps(batches):
            raw, out = data.tobytes(), []
            for doc_id, a, b in zip(rows.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                ids = encode(raw[a:b].decode())
                at, to, piece = 0, (len(ids) - 1) % window + 1, 0
                while at < len(ids):
                    crc = zlib.crc32(ids[at:to].astype("<u4").tobytes())
                    out.append((doc_id, piece, at, to - at, crc, number))
                    at, to, piece, number = to, to + window, piece + 1, number + 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, _PIECES)


_STATE = "shard long, island int, sizes binary, population array<binary>, bins int, least int, squares long"


def _evolve(epoch: int, window: int, population: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                problem = Problem(np.frombuffer(row["sizes"], np.int32).tolist(), window)
                rng = random.Random(f"{row['shard']} {row['island']} {epoch}")
                held = [decoded(p) for p in row["population"] or ()] or problem.first(population, rng)
                held = problem.evolve(held, population, generations, rng)
                bins, squares = problem.quality(held[0])
                out = row | {"population": [coded(b, len(problem.sizes)) for b in held], "bins": bins, "least": problem.least, "squares": squares}
                yield pa.RecordBatch.from_pylist([{c: out[c] for c in (x.split()[0] for x in _STATE.split(", "))}], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema(
    [
        ("shard", pa.int64()),
        ("island", pa.int32()),
        ("sizes", pa.binary()),
        ("population", pa.list_(pa.binary())),
        ("bins", pa.int32()),
        ("least", pa.int32()),
        ("squares", pa.int64()),
    ]
)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column(1).to_pylist()
        yield record({"shard": batch.column(0), "sizes": pa.array([np.array(x, np.int32).tobytes() for x in lengths], pa.binary())})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each item of a shard lies."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes, bin_of = np.frombuffer(row["sizes"], np.int32).astype(np.int64), np.frombuffer(row["solution"], np.int32)
            order = np.argsort(bin_of, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            head = np.ones(len(order), bool)
            head[1:] = bin_of[order][1:] != bin_of[order][:-1]
            offset = np.empty(len(order), np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(head, before, 0))
            yield record(
                {
                    "item": np.array(row["items"], np.int64),
                    "sequence_id": (row["shard"] << 32) + bin_of.astype(np.int64),
                    "offset": offset,
                }
            )


def islands(shards: DataFrame, window: int, islands_: int, epochs: int, population: int, generations: int) -> DataFrame:
    """``(shard, bins, least, solution)``: the best solution of each shard of ``(shard, sizes)``."""
    state = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands_ - 1))))
    state = state.select("shard", "island", "sizes", F.lit(None).cast("array<binary>").alias("population"))
    state = state.withColumns({c: F.lit(None).cast("int") for c in ("bins", "least")}).withColumn("squares", F.lit(None).cast("long"))
    done = None
    for epoch in range(epochs):
        # Rows are few and dear: each is evolved where it falls by shard and island.
        cores = shards.sparkSession.sparkContext.defaultParallelism
        state = state.repartition(4 * cores, "shard", "island").mapInArrow(_evolve(epoch, window, population, generations), _STATE)
        state = stored(state)
        best = state.groupBy("shard").agg(
            F.min_by(F.struct("bins", "least", F.col("population")[0].alias("solution")), F.struct("bins", "squares", "island")).alias("b")
        )
        best = best.select("shard", "b.*")
        last = epoch + 1 == epochs
        ended = best if last else best.where("bins <= least")
        done = ended if done is None else done.unionByName(ended)
        if not last:
            on = state.join(best.where("bins > least").select("shard"), "shard", "left_semi")
            elite = on.select(
                "shard", ((F.col("island") + 1) % islands_).alias("island"), F.slice("population", 1, ELITE).alias("elite")
            )
            # Populations are ranked; those that come take the places of the worst.
            stay = F.slice("population", F.lit(1), F.greatest(F.size("population") - ELITE, F.lit(1)))
            state = on.join(elite, ["shard", "island"]).withColumn("population", F.concat(stay, "elite")).drop("elite")
            state = state.select(*[c.split()[0] for c in _STATE.split(", ")])
    return done


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    window: int = WINDOW,
    shard_pieces: int = SHARD_PIECES,
    islands_: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = stored(pieces(docs, tokenizer, end_id, window))
    count = cut.where(F.col("length") < window).count()
    shards = max(-(-count // shard_pieces), 1)
    part = cut.where(F.col("length") < window).withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    held = part.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("h"))
    held = stored(held.select("shard", F.col("h.item").alias("items"), F.col("h.length").cast("array<int>").alias("lengths")))
    sizes = held.select("shard", "lengths").mapInArrow(_sizes, "shard long, sizes binary")
    solved = stored(islands(sizes, window, islands_, epochs, population, generations))
    both = held.select("shard", "items").join(solved.select("shard", "solution"), "shard").join(sizes, "shard")
    placed = both.select("shard", "items", "sizes", "solution").mapInArrow(_places, "item long, sequence_id long, offset long")
    whole = cut.where(F.col("length") == window)
    whole = whole.withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")}).drop("item")
    return cut.where(F.col("length") < window).join(placed, "item").drop("item").unionByName(whole)
