"""Repeated byte strings by suffix arrays.

The table is read in shards of a megabyte. A shard's suffixes are sorted by Larsson-Sadakane
refinement, common prefixes of neighbours are found by Kasai's method, and each group of places that
start the same ``width`` bytes closes all its places but the first: within a shard, all is told.

Across shards a shard states only what is still open, and not each place: windows of ``width`` bytes
choose the least, by a hash, of the short strings inside them as anchor, and neighbours with one anchor
are one context. The shards' contexts, sorted by anchor, are merged in sorted ranges whose bounds are
searched by halving. Of equal contexts only the first can be new, and only if its anchor has
other contexts as well (``judgespark.llm.repeats``). Those first contexts are cut into pieces of few
windows, aligned to the anchor, and merged again; what is then still open is compared window by window.

Null texts count as empty, shorter texts keep all their bytes, rows without ``doc_id`` come after all
others, of repeated rows the first scanned is the first, an empty table gives no rows, other columns
are not read. A shard holds whole documents, at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.llm.common import Rolling, byte_symbols, mix, numbered, record, steps, stored, text_of
from judgespark.llm.repeats import CONTEXTS, contexts, gathered, open_and_closed, windows
from judgespark.llm.substring_dedup import _ids, covered, spans_of
from judgespark.llm.suffix_array import later_copies

WIDTH, ANCHOR, PIECE = 100, 24, 8
SHARD_BYTES = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _in_order(rows, data, offsets):
    """The step's documents by id, so that the place of a byte tells which is earlier."""
    ids, numbers = _ids(rows)
    order = np.lexsort((numbers, ids))
    if (order == np.arange(len(order))).all():
        return ids, numbers, data, offsets
    parts = [data[offsets[i] : offsets[i + 1]] for i in order]
    return ids[order], numbers[order], np.concatenate(parts), np.concatenate([[0], np.cumsum(np.diff(offsets)[order])])


def _window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    change = np.zeros(offsets[-1] + 1, np.int64)
    long = np.diff(offsets) >= width
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - width + 1, -1)
    return np.cumsum(change)[:-1] > 0


def _anchors(first: Rolling, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of the short string at each place, and the anchor of the window at each place."""
    name = first.every(size)
    least = _ranked(name, np.arange(len(name)))
    span, have = width - size + 1, 1
    if len(least) < span:
        return name, np.zeros(0, np.int64)
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: have - span], least[span - have :])
    return name, _place(least)


def _ranked(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Half of a name, then its place: the least of a window is its anchor."""
    return (name & ~_LOW) | at.astype(np.uint64)


def _place(ranked: np.ndarray) -> np.ndarray:
    return (ranked & _LOW).astype(np.int64)


def _anchors_of(first: Rolling, start: np.ndarray, width: int, size: int) -> np.ndarray:
    """The anchors of the windows at a few places."""
    out = np.empty(len(start), np.int64)
    for a in range(0, len(start), 8192):
        at = start[a : a + 8192, None] + np.arange(width - size + 1)
        out[a : a + 8192] = _place(_ranked(first.of(at, at + size), at).min(axis=1))
    return out


def _find(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, limit=SHARD_BYTES):
            ids, numbers, data, offsets = _in_order(rows, data, offsets)
            valid = _window_starts(offsets, width)
            late = later_copies(data, valid, width)
            hashes = Rolling(byte_symbols(data))
            name, anchor = _anchors(hashes, width, size)
            at = np.flatnonzero(valid)
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]])
            heads = np.flatnonzero(head)
            n = np.diff(np.append(heads, len(at)))
            live = np.add.reduceat(~late[at], heads) > 0 if len(heads) else np.zeros(0, bool)
            start, n = at[heads][live], n[live]
            place = anchor[start]
            whole = hashes.of(start, start + n - 1 + width)
            doc = np.searchsorted(offsets, start, "right") - 1
            kf = mix(whole + (place - start).astype(np.uint64))
            yield contexts(name[place], kf, ids[doc], numbers[doc], start - offsets[doc], n)
            yield _closed(late, ids, numbers, offsets)

    return run


def _closed(late, ids, numbers, offsets) -> pa.RecordBatch:
    """Runs of places that the shard closed."""
    at = np.flatnonzero(late)
    doc = np.searchsorted(offsets, at, "right") - 1
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(head)
    doc = doc[heads]
    return record(
        {
            "k": np.zeros(len(heads), np.int64),
            "kf": np.zeros(len(heads), np.int64),
            "doc_id": ids[doc],
            "_row": numbers[doc],
            "start": (at[heads] - offsets[doc]).astype(np.int32),
            "n": np.diff(np.append(heads, len(at))).astype(np.int32),
            "heavy": np.full(len(heads), -1, np.int32),
        }
    )


def _pieces(width: int, size: int, piece: int):
    """Contexts cut every ``piece`` windows, counted from the anchor, and named by the bytes all of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, limit=SHARD_BYTES):
            ids, numbers = _ids(rows)
            doc, start, n = spans_of(rows, offsets[:-1])
            hashes = Rolling(byte_symbols(data))
            place = _anchors_of(hashes, start, width, size)
            # Piece j of an anchor holds the windows that start j * piece to j * piece + piece - 1 before it.
            low, high = (place - start - n + 1) // piece, (place - start) // piece
            count = high - low + 1
            which = np.repeat(np.arange(len(start)), count)
            j = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            from_ = np.maximum(place[which] - (j + 1) * piece + 1, start[which])
            to = np.minimum(place[which] - j * piece, start[which] + n[which] - 1)
            core_from, core_to = place[which] - j * piece, place[which] - (j + 1) * piece + 1 + width
            k = mix(hashes.of(core_from, core_to) + np.uint64(1))
            kf = mix(hashes.of(from_, to + width) + (place[which] - from_).astype(np.uint64))
            doc = doc[which]
            yield contexts(k, kf, ids[doc], numbers[doc], from_ - offsets[doc], to - from_ + 1)

    return run


def _single(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, limit=SHARD_BYTES):
            ids, numbers = _ids(rows)
            doc, start, n = spans_of(rows, offsets[:-1])
            at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(doc, n)
            two = [Rolling(byte_symbols(data, w), w).of(at, at + width) for w in (0, 1)]
            yield windows(*two, ids[doc], numbers[doc], at - offsets[doc])

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            gone = covered(rows, offsets[:-1], len(data), width)
            before = np.concatenate([[0], np.cumsum(gone)])[offsets]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = offsets[:-1][offsets[:-1] < len(data)]
            begins[edge] = gone[edge]
            runs = np.concatenate([[0], np.cumsum(begins)])[offsets]
            rest = data[~gone].tobytes()
            at = offsets - before
            yield record(
                {
                    "doc_id": rows.column(rows.schema.get_field_index("doc_id")),
                    "n_bytes": np.diff(offsets),
                    "n_removed": np.diff(before),
                    "n_spans": np.diff(runs),
                    "kept": pa.array([rest[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                }
            )

    return run


def repeated_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(_row, starts, counts)``: in each document the runs of places that start ``width`` bytes which also
    start earlier."""
    size = min(ANCHOR, max(width // 4, 1))
    piece = min(PIECE, size)
    rows = numbered(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = stored(rows.mapInArrow(_find(width, size), CONTEXTS))
    first = stored(open_and_closed(found, True, by_range=True))
    cut = rows.join(gathered(first.where("NOT closed")), "_row").mapInArrow(_pieces(width, size, piece), CONTEXTS)
    second = stored(open_and_closed(stored(cut), True, by_range=True))
    single = rows.join(gathered(second.where("NOT closed")), "_row").mapInArrow(_single(width), CONTEXTS)
    third = open_and_closed(stored(single), False, by_range=True)
    closed = first.where("closed").unionByName(second.where("closed")).unionByName(third)
    return stored(gathered(closed.drop("closed")))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row of ``docs`` (a stored table): ``kept`` holds the
    bytes that no repeated string covers, ``n_spans`` counts the longest removed runs."""
    spans = repeated_bytes(docs, width)
    rows = numbered(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.join(spans, "_row", "left").mapInArrow(_cut(width), schema)
