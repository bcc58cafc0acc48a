"""Hard negatives: rows of another label that score just below an anchor's positives, by exact integer products.

Components become whole numbers, and several rows are packed into one vector of wide integers: each row's component,
shifted to be non-negative, takes a field of bits of its own, wide enough for a whole inner product. One
multiplication by an anchor's component serves all fields at once, sums of such products are sums in every
field, and the exact scores are read from the fields afterwards. Wide integers of up to 53 bits are
held by doubles, which are exact there, so the products of a block are one matrix product; where a
score alone needs more bits, Python's integers of any width take their place.

Every row is dealt to a group of bounded size by its place in the scan; anchors go to all groups. A task reads the
rows of a group once, packs them, and streams the anchors past, a few at a time. It gives the
nearest rows of each anchor only, which are ranked over all groups. This is done twice, for the
positives and, when their scores are known, for the rows below them.

Rows with a null label, a null vector, or null or non-finite components take no part, neither do rows without id,
which could not be named. A row is not its own positive or negative, but another row with its id may
be; rows of equal score and id are ranked by their place. Rows whose vectors differ in length never
meet. An anchor without positives, and a positive without negatives, gives no rows; an empty table gives
none; other columns are not read. A score beyond 64 bits is ranked and compared as what it is, and
returned as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgespark.llm.common import numbered, stored

SCALE = 256
POSITIVES = NEGATIVES = 5
SHARE = (80, 100)
GROUP_ROWS, GROUP_BYTES = 16_384, 64 << 20  # of one group of rows, whichever is less
AT_ONCE = 128  # anchors
EXACT_BITS, FIELDS = 53, 16  # of a double, and the fields of a wider integer


def eligible(table: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """``(_row, id, label, vector, dim)`` of the rows that take part, stored."""
    rows = numbered(table).select(
        "_row",
        F.col(id_column).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    return stored(rows.withColumn("dim", F.size("vector")))


def whole(values: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """``floor(scale * x)`` of each component, as doubles that are whole numbers or, if ``wide``, as Python's integers."""
    if not wide:
        return np.floor(scale * values)
    out = np.empty(values.shape, object)
    # From 2**53 on every double is a whole number, and scaling it could leave the range of doubles.
    out.flat = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x) for x in values.ravel().tolist()]
    return out


class Packed:
    """Rows as wide integers, several to a vector. ``bound`` is no less than any component of a row or an anchor."""

    def __init__(self, rows: np.ndarray, bound: int):
        n, self.dim = rows.shape
        self.n, self.bound = n, bound
        self.bits = max((self.dim * (2 * bound) ** 2).bit_length(), 1)
        self.wide = self.bits > EXACT_BITS
        self.fields = FIELDS if self.wide else EXACT_BITS // self.bits
        kind = object if self.wide else np.float64
        held = np.zeros((-(-n // self.fields) * self.fields, self.dim), kind)
        held[:n] = rows + bound
        self.packed = np.zeros((len(held) // self.fields, self.dim), kind)
        for f in range(self.fields):
            self.packed += held[f :: self.fields] * (1 << self.bits * f)
        self.sums = rows.sum(1) if self.dim else np.zeros(n, kind)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner product of each anchor and row, exactly."""
        products = (anchors + self.bound) @ self.packed.T
        kind = object if self.wide else np.int64
        products = products.astype(kind)
        out = np.empty((len(anchors), products.shape[1] * self.fields), kind)
        for f in range(self.fields):
            out[:, f :: self.fields] = (products >> (self.bits * f)) & ((1 << self.bits) - 1)
        # (a + bound) * (c + bound) summed is a * c, bound times both sums, and bound squared for each component.
        more = anchors.sum(1)[:, None] + self.sums[None, :] + self.dim * self.bound
        return out[:, : self.n] - more.astype(kind) * self.bound


def fields_needed(dim: int, bound: int) -> bool:
    """Whether scores need integers wider than a double holds."""
    return (dim * (2 * bound) ** 2).bit_length() > EXACT_BITS


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor, row)`` of the ``k`` highest allowed scores of each anchor, highest first, ties by row."""
    if scores.dtype == object:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    if scores.shape[1] > k:
        low = np.iinfo(np.int64).min
        least = np.partition(np.where(allowed, scores, low), -k, axis=1)[:, -k]
        allowed = allowed & (scores >= least[:, None])
    anchor, row = np.nonzero(allowed)
    order = np.lexsort((row, -scores[anchor, row], anchor))
    anchor, row = anchor[order], row[order]
    nth = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    return anchor[nth < k], row[nth < k]


def key_bytes(dim: int, bound: int) -> int:
    return -(-((dim * bound * bound).bit_length() + 2) // 8)


def keys(scores: list[int], width: int) -> list[bytes]:
    """Scores as bytes that sort like them."""
    shift = 1 << (8 * width - 1)
    return [(s + shift).to_bytes(width, "big") for s in scores]


def of_keys(held: list[bytes], width: int) -> list[int]:
    return [int.from_bytes(k, "big") - (1 << (8 * width - 1)) for k in held]


_FOUND = "anchor long, nth int, id long, row long, key binary, score long"
_MET = "_group long, dim int, anchor boolean, id long, _row long, label long, vector array<double>, above array<binary>"


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _search(largest: float, widest: int, scale: int, k: int, share: tuple[int, int]):
    """Rows of a group and then anchors stream in; ``nth`` is the positive that a row lies below, or 0 for the
    positives themselves, which are looked for where ``above`` is null."""
    bound = max(int(largest) * scale if largest >= 2.0**53 else math.ceil(largest * scale), 1)
    wide, width = fields_needed(widest, bound), key_bytes(widest, bound)
    least, full = share

    def found(packed: Packed, ids, places, labels, anchors: pa.RecordBatch):
        scores = packed.scores(whole(_vectors(anchors, packed.dim), scale, packed.wide))
        own = anchors.column(4).to_numpy()
        alike = anchors.column(5).to_numpy()[:, None] == labels[None, :]
        above = anchors.column(7).to_pylist()
        if above[0] is None:
            rounds = [(0, *best(scores, alike & (own[:, None] != places[None, :]), k))]
        else:
            rounds = []
            limits = [of_keys(a, width) for a in above]
            for nth in range(max(map(len, limits))):
                has = np.array([len(x) > nth for x in limits])
                limit = np.array([x[nth] if len(x) > nth else 0 for x in limits], scores.dtype)[:, None]
                near = (least * limit <= full * scores) & (scores <= limit) & ~alike & has[:, None]
                rounds.append((nth + 1, *best(scores, near, k)))
        for nth, anchor, row in rounds:
            held = scores[anchor, row].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own[anchor]),
                    pa.array(np.full(len(anchor), nth, np.int32)),
                    pa.array(ids[row]),
                    pa.array(places[row]),
                    pa.array(keys(held, width), pa.binary()),
                    pa.array([s if -(2**63) <= s < 2**63 else None for s in held], pa.int64()),
                ],
                names=[c.split()[0] for c in _FOUND.split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, packed = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([m[1:] != m[:-1] for m in mark], axis=0)
            heads = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(heads, heads[1:]):
                part = batch.slice(a, b - a)
                here, dim = (mark[0][a], mark[1][a]), int(mark[1][a])
                if here != group:
                    group, held, packed = here, [], None
                if not mark[2][a]:
                    held.append(part)
                    continue
                if packed is None:
                    if not held:  # nobody to meet
                        continue
                    ids, places, labels = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (3, 4, 5))
                    vectors = np.concatenate([_vectors(h, dim) for h in held])
                    held = []
                    packed = Packed(whole(vectors, scale, wide or fields_needed(dim, bound)), bound)
                for at in range(0, part.num_rows, AT_ONCE):
                    yield from found(packed, ids, places, labels, part.slice(at, AT_ONCE))

    return run


def _groups(count: int, widest: int, cores: int) -> int:
    """Groups of at most ``GROUP_ROWS`` rows and ``GROUP_BYTES`` of components, enough of them for all cores."""
    rows = min(GROUP_ROWS, max(GROUP_BYTES // (8 * max(widest, 1)), 1))
    return max(-(-count // rows), min(4 * cores, -(-count // 1024)), 1)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: tuple[int, int] = SHARE,
    scale: int = SCALE,
) -> DataFrame:
    """For each anchor of ``rows`` (from :func:`eligible`) and each of its ``positives`` best rows of its label, the
    first ``negatives`` rows of other labels with a score from ``share`` of the positive's up to the
    positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` and the
    positive's own rank."""
    spark = rows.sparkSession
    size = F.array_max(F.transform("vector", F.abs))
    count, widest, largest = rows.agg(F.count(F.lit(1)), F.max("dim"), F.max(size)).first()
    groups = _groups(count, widest or 0, spark.sparkContext.defaultParallelism)
    work = lambda k: _search(largest or 0.0, widest or 0, scale, k, share)
    none = F.lit(None).cast("array<binary>")
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    dealt = dealt.withColumns({"anchor": F.lit(False), "above": none})
    asked = rows.where(anchors)
    columns = [c.split()[0] for c in _MET.split(", ")]

    def meet(asking: DataFrame, k: int) -> DataFrame:
        """The ``k`` best rows of each anchor and limit over all groups."""
        everywhere = asking.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        both = dealt.select(columns).unionByName(everywhere.withColumn("anchor", F.lit(True)).select(columns))
        both = both.repartition(groups, "_group").sortWithinPartitions("_group", "dim", "anchor", "id", "_row")
        met = both.mapInArrow(work(k), _FOUND)
        order = Window.partitionBy("anchor", "nth").orderBy(F.desc("key"), "id", "row")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = stored(meet(asked.withColumn("above", none), positives))
    above = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("above"))
    above = above.select(F.col("anchor").alias("_row"), F.col("above.key").alias("above"))
    below = meet(asked.join(above, "_row"), negatives)
    near = near.select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = below.join(near, ["anchor", "nth"]).join(asked.select(F.col("_row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
        F.col("nth").alias("positive_rank"),
    )
