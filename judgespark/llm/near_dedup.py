"""Near-duplicate documents by MinHash.

Texts become sets of hashed word shingles. Documents with equal sets are one class, of which one member
goes on. Many universal hash minima are cut into bands; classes that share a band meet in its bucket.

1. Star: every member of a bucket is compared with its least member: sizes, then signatures, then full
   sets. The links give components.
2. Rest: what a star cannot tell are links between two members of a bucket that it left in different
   components. Those members are compared on full sets, in blocks of bounded size, without the pairs
   inside the bucket's largest component. Only links that join something are returned.

So no bucket is capped, no pair of copies is listed, and no link within a bucket is lost. Components are
found by alternating stars. Null texts count as empty. Empty documents are linked with nothing; rows
with the same ``doc_id`` are one document; a null ``doc_id`` is linked with nothing; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.llm.common import Rolling, lookup, lower, mix, signed, steps, stored, text_of, word_hashes, words
from judgespark.llm.components import components

SHINGLE, PERCENT = 5, 85
BANDS, BAND_ROWS = 16, 5
MISS = 1e-6
BLOCK = 128


def bands_for(percent: int, miss: float = MISS) -> int:
    """Bands with which a pair at ``percent`` shares no bucket at most as often as ``miss``."""
    meets = (percent / 100) ** BAND_ROWS
    return math.ceil(math.log(miss) / math.log1p(-meets)) if meets < 1 else 1


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of ``n`` universal hashes."""
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, and where each document's begin."""
    data = lower(data)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    roll, out, bounds = Rolling(hashes), [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b > a:
            at = np.arange(a, max(b - size, a) + 1)
            got = np.sort(roll.of(at, np.minimum(at + size, b)))
            got = got[np.concatenate([[True], got[1:] != got[:-1]])]
            out.append(got)
            bounds.append(bounds[-1] + len(got))
        else:
            bounds.append(bounds[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(bounds)


def _arrays(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """``(doc_id, n_shingles, digest, signature)`` of every row; no signature without words."""
    factor, offset = _universal(bands * BAND_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            sets, bounds = shingle_sets(data, offsets, size)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            minima = np.zeros((len(n), len(factor)), np.int32)
            digest = np.zeros((len(n), 2), np.uint64)
            if len(some):
                at = bounds[some]
                for i in range(len(factor)):
                    value = sets * factor[i]
                    value += offset[i]
                    minima[some, i] = (np.minimum.reduceat(value, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                digest[some, 0] = np.add.reduceat(mix(sets), at)
                digest[some, 1] = np.add.reduceat(mix(sets ^ offset[0]), at)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n.astype(np.int64)),
                    pa.array([d.tobytes() for d in digest], pa.binary()),
                    _arrays(minima.ravel(), np.arange(len(n) + 1) * len(factor)),
                ],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<int>")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(id, shingles)`` of the wanted documents.

    Their number grows with the table, so the texts meet it in a shuffle at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            sets, bounds = shingle_sets(data, offsets, size)
            yield pa.RecordBatch.from_arrays([rows.column(0), _arrays(signed(sets), bounds)], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    return rows.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def _near(percent: int):
    """Links among the members of a block, without those between equal labels; at most one link a member."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        ids, labels = cell["id"].to_numpy(), cell["label"].to_numpy()
        sets = [np.asarray(s) for s in cell["shingles"]]
        size = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        root = {x: x for x in labels.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out, mark = [], np.zeros(token.max() + 1, bool)
        for i in np.flatnonzero(cell["rest"].to_numpy()):
            own = token[starts[i] : starts[i] + size[i]]
            mark[own] = True
            shared = np.add.reduceat(mark[token], starts)
            mark[own] = False
            near = (100 * shared >= percent * (size + size[i] - shared)) & (labels != labels[i])
            for j in np.flatnonzero(near):
                a, b = find(labels[i]), find(labels[j])
                if a != b:
                    root[a] = b
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket whose star left them in different components."""
    labelled = members.where("id != hub").join(labels.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("key", "id", F.coalesce("label", "id").alias("label"))
    parts = labelled.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")
    )
    open_keys = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.sum("n").alias("n"),
        F.max_by("label", F.struct("n", "label")).alias("main"),
        F.max("n").alias("n_main"),
        F.sum("mark").alias("mark"),
    ).where("n_labels > 1")
    # Buckets with the same members are one bucket.
    open_keys = open_keys.groupBy("mark", "n").agg(F.min(F.struct("key", "main", "n_main")).alias("k"))
    open_keys = stored(open_keys.select("k.*", "n"))
    n_rest, n_main = (F.ceil((F.col("n") - F.col("n_main")) / BLOCK), F.ceil(F.col("n_main") / BLOCK))
    rows = lookup(labelled, open_keys, "key", "n").withColumns(
        {"rest": F.col("label") != F.col("main"), "n_rest": n_rest.cast("int"), "n_main": n_main.cast("int")}
    )
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("n_rest")).otherwise(F.col("n_main"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda r, main, o: F.struct(r.alias("r"), F.lit(main).alias("main"), o.alias("o"))
    own = F.col("own")
    cells = F.when(
        F.col("rest"),
        F.concat(
            F.transform(upto(F.col("n_main")), lambda j: cell(own, True, j)),
            F.transform(upto(F.col("n_rest")), lambda j: cell(F.least(own, j), False, F.greatest(own, j))),
        ),
    ).otherwise(F.transform(upto(F.col("n_rest")), lambda j: cell(j, True, own)))
    dealt = rows.select("key", "id", "label", "rest", F.explode(cells).alias("cell"))
    return dealt.join(sets, "id").groupBy("key", "cell").applyInPandas(_near(percent), "a long, b long")


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs`` (a stored table).

    By default there are bands enough that a pair right at ``percent`` shares no bucket once in a million (``MISS``),
    and more similar ones more rarely; a pair that shares one is never lost.
    """
    bands = bands_for(percent) if bands is None else bands
    rows = stored(signatures(docs, size, bands))
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        some.groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"),
            F.first("signature").alias("signature"),
        )
    )
    band = lambda b: F.xxhash64(F.lit(b), F.slice("signature", b * BAND_ROWS + 1, BAND_ROWS))
    banded = classes.select("id", F.explode(F.array(*[band(b) for b in range(bands)])).alias("key"))
    buckets = banded.groupBy("key").agg(
        F.min("id").alias("hub"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("members")
    )
    buckets = stored(buckets.where("hub != _last").drop("_last"))
    members = stored(lookup(banded, buckets, "key", "members").drop("members"))
    sets = stored(_full_sets(docs, members.select("id").distinct(), size))

    # Star: sizes, signatures, then full sets.
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    pairs = members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    # The share of equal minima estimates the similarity; a true link misses this bound once in 10**7.
    likely = same >= int(bands * BAND_ROWS * (percent / 100 - 0.25))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = stored(pairs.where(fits & likely).select("a", "b"))
    full = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"f_{x}"))
    shared = F.size(F.array_intersect("f_a", "f_b"))
    checked = pairs.join(full("a"), "a").join(full("b"), "b").select(
        "a", "b", shared.alias("both"), (F.size("f_a") + F.size("f_b")).alias("all")
    )
    links = stored(checked.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b"))
    labels = stored(components(links))
    more = stored(_rest(members, labels, sets, percent))
    if not more.isEmpty():
        stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = stored(components(stars.unionByName(more)))

    named = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", "rows", F.coalesce("label", "id").alias("component_id")
    )
    linked = lookup(some.drop("signature"), stored(named), "digest", "rows").drop("rows")
    alone = rows.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select(
        "doc_id", "n_shingles", "digest", F.col("doc_id").alias("component_id")
    )
    out = linked.unionByName(alone).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
