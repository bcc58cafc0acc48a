"""Quality of texts by votes of their nearest labelled neighbours in a latent-semantic space.

A text is a bag of terms: its words, the shapes of its words (runs of upper case, lower case, digits and of each
other sign), and for each word whether the one before was the same. Terms are hashed to a fixed number of
columns, weighted by rarity, and projected on the first singular directions of a bounded sample of
labelled texts (``FIT_DOCS`` rows, by a hash of their ids). The sample's own vectors are broadcast: ``FIT_DOCS``
rows of ``LATENT`` numbers. Every text is compared with all of them by exact cosine products, a
block of texts at a time, and its score is the vote of the ``NEIGHBOURS`` nearest, weighted by a power of
their similarity.

Null and empty texts, and texts like no labelled one, score as the sample does on the whole. Labels without a
value or without a text take no part; of several labels of a document each votes. Without labels
every score is 0.5. Repeated rows score alike, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from judgespark.llm.common import Rolling, byte_symbols, mix, record, steps, word_hashes, words

FIT_DOCS, LATENT, NEIGHBOURS = 8000, 48, 25
WORD_COLUMNS, SHAPE_COLUMNS = 3072, 1024
SHARPNESS = 8
COLUMNS = WORD_COLUMNS + SHAPE_COLUMNS
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")
_SAME = (np.uint64(0x51ED270B27C1D4A5), np.uint64(0x3C6EF372FE94F82B))


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's classes of characters, runs as one."""
    kind = _CLASS[data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    before = np.concatenate([[0], np.cumsum(change)])
    return Rolling(byte_symbols(kind[change], 1), 1).of(before[starts], before[ends])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and weights of the terms of each text, and where each text's begin."""
    starts, ends, first = words(data, offsets)
    n_docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(n_docs + 1, np.int64)
    word, shape = word_hashes(data, starts, ends), _shapes(data, starts, ends)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < len(word)]] = False
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    column = np.concatenate(
        [
            mix(word) % np.uint64(WORD_COLUMNS),
            WORD_COLUMNS + mix(shape) % np.uint64(SHAPE_COLUMNS),
            WORD_COLUMNS + mix(np.where(same, *_SAME)) % np.uint64(SHAPE_COLUMNS),
        ]
    ).astype(np.int64)
    key = np.concatenate([doc, doc, doc]) * COLUMNS + column
    key, times = np.unique(key, return_counts=True)
    doc, column = key // COLUMNS, key % COLUMNS
    size = np.diff(first)[doc]
    # Words by how often they occur, shapes by their share of the text.
    weight = np.where(column < WORD_COLUMNS, np.log1p(times), 8 * np.sqrt(times / size)).astype(np.float32)
    return column.astype(np.int32), weight, np.searchsorted(doc, np.arange(n_docs + 1))


class Space(NamedTuple):
    """The latent space and the labelled vectors in it."""

    rarity: np.ndarray  # by column
    axes: np.ndarray  # columns x latent
    vectors: np.ndarray  # labelled texts x latent, of length 1
    labels: np.ndarray

    def project(self, column: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bounds) - 1, self.axes.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(bounds))
        value = _halves(column, weight * self.rarity[column], bounds)
        for at in range(0, len(some), 256):  # a block of texts at a time
            part = some[at : at + 256]
            a, b = bounds[part[0]], bounds[part[-1] + 1]
            out[part] = np.add.reduceat(self.axes[column[a:b]] * value[a:b, None], bounds[part] - a)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def vote(self, vectors: np.ndarray, neighbours: int) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(vectors), prior)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(vectors) if k else 0, 512):
            near = vectors[at : at + 512] @ self.vectors.T
            top = np.argpartition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            voted = (weight * self.labels[top]).sum(1)
            out[at : at + 512] = np.divide(voted, total, out=out[at : at + 512].copy(), where=total > 1e-9)
        return np.clip(out, 0.0, 1.0)


def _halves(column: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words and shapes of each text brought to the same length."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    half = (column >= WORD_COLUMNS).astype(np.int64)
    group = doc * 2 + half
    length = np.sqrt(np.bincount(group, value.astype(np.float64) ** 2, minlength=2 * (len(bounds) - 1)))
    return (value / np.maximum(length, 1e-12)[group]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, latent: int) -> Space:
    """Rarity of the columns and first singular directions of the labelled texts, by random projection.

    One table of texts by columns is held, and nothing else of that size.
    """
    n = len(rows)
    held = np.zeros(COLUMNS, np.int64)
    for column, _ in rows:
        held[column] += 1  # a text has a column once
    rarity = np.log((1 + n) / (1 + held)).astype(np.float32) + 1
    latent = min(latent, max(n, 1))
    table = np.zeros((n, COLUMNS), np.float32)
    for at, (column, weight) in enumerate(rows):
        table[at, column] = _halves(column, weight * rarity[column], np.array([0, len(column)]))
    axes = np.random.default_rng(11).standard_normal((COLUMNS, latent + 16)).astype(np.float32)
    for _ in range(4):
        axes = np.linalg.qr(table.T @ (table @ axes))[0]
    _, _, turn = np.linalg.svd(table @ axes, full_matrices=False)
    axes = np.ascontiguousarray((axes @ turn.T)[:, :latent])
    vectors = table @ axes
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return Space(rarity, axes, vectors, labels.astype(np.float64))


_TABLE = "doc_id long, label double, columns array<int>, weights array<float>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each labelled document, the least of a task where an id repeats, so a task holds one for each label."""
    held: dict[tuple[int, float], tuple[list, list]] = {}
    for rows, data, offsets in steps(batches):
        column, weight, bounds = terms(data, offsets)
        for i, key in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
            mine = column[bounds[i] : bounds[i + 1]].tolist(), weight[bounds[i] : bounds[i + 1]].tolist()
            held[key] = min(held.get(key, mine), mine)
    if held:
        ids, labels = zip(*held)
        columns, weights = zip(*held.values())
        yield record({"doc_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.float64()), "columns": pa.array(columns, pa.list_(pa.int32())), "weights": pa.array(weights, pa.list_(pa.float32()))})


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, latent: int = LATENT) -> Space:
    """Fit on at most ``fit_docs`` of ``labels (doc_id, label)``. A text has at most ``COLUMNS`` terms, and of rows
    with one id only the one with the least terms counts, so what comes to the driver is bounded,
    however long the texts are and however often an id repeats."""
    some = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("label"))
    some = some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_docs)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    found = texts.mapInArrow(_features, _TABLE).groupBy("doc_id", "label").agg(F.min(F.struct("columns", "weights")).alias("f"))
    table = found.select("doc_id", "label", "f.*").orderBy("doc_id", "label").select("label", "columns", "weights").toArrow()
    rows = list(zip(*(_split(table.column(c).combine_chunks()) for c in ("columns", "weights"))))
    return fit(rows, table.column("label").to_numpy(), latent)


def _split(column: pa.ListArray) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []


def scores(docs: DataFrame, space: Space, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with a column ``_score`` from 0 to 1: the likelihood of label 1."""
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            got = space.vote(space.project(*terms(data, offsets)), neighbours)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got)], names=[*rows.schema.names, "_score"])

    return docs.mapInArrow(run, schema)

