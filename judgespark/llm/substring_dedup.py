"""Repeated word windows by recompression.

Rounds give every run of equal symbols, and then every pair of a left and a right symbol, one new symbol. A
symbol's name is a hash of what it stands for and its side a bit of its name, so the names are the
same in the whole corpus, and equal stretches get equal symbols except near their ends. How far a
boundary depends on its surroundings is carried along, so each window knows which boundaries inside it
are told by its own words. The two symbols before such a boundary and the two after it are an anchor:
repeated anchors of high-level symbols reveal the repeats, which are then verified on the whole windows
(``judgespark.llm.repeats``). The number of rounds follows from the window: the most for which a window
without runs always has an anchor inside; a window in a long run is compared as a whole.

Null texts count as empty; a text shorter than a window keeps all its words; rows without ``doc_id`` come
after all others and of repeated rows the first scanned is the first; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.llm.common import Rolling, lists, mix, numbered, record, steps, stored, text_of, word_hashes, words
from judgespark.llm.repeats import CONTEXTS, contexts, gathered, open_and_closed, pick_anchors, windows

WINDOW, SIDE = 20, 2
_RUN, _LEFT, _RIGHT, _ALONE, _WHOLE = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
_NO_ID = np.iinfo(np.int64).max


def rounds_for(window: int) -> int:
    """The most rounds after which every window without runs has an anchor that it can tell by itself.

    Without runs, a symbol of round r has at most 2**r words and its boundary depends on 2 * (2**r - 1)
    words on either side. An anchor needs its symbols as well, and within the places that are
    left there must be a boundary, which comes at every 2**r words at least.
    """
    left = lambda r: window + 1 - 2 * (2 * (2**r - 1) + SIDE * 2**r)
    r = 0
    while left(r + 1) >= 2 ** (r + 1):
        r += 1
    return r


class Parse:
    """The symbols after ``rounds`` of naming runs and pairs; documents are held apart by marks."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, rounds: int):
        n_docs = len(first) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        self.place = np.arange(len(hashes)) + doc + 1  # of each word
        size = len(hashes) + n_docs + 1
        self.words = np.zeros(size, np.uint64)
        self.words[self.place] = hashes
        self.mark = np.ones(size, bool)
        self.mark[self.place] = False
        self.name, self.start = self.words.copy(), np.arange(size)
        self.low, self.high = self.start.copy(), self.start.copy()
        self._mark = self.mark
        for r in range(rounds):
            same = self.name[1:] == self.name[:-1]
            at = self._keep(~(same & ~self._mark[1:] & ~self._mark[:-1]))
            count = np.diff(np.append(at, len(self._old))).astype(np.uint64)
            self.name = np.where(count > 1, mix(self._old[at] * _RUN + count), self._old[at])
            side = mix(self.name + np.uint64(r + 1) * _ALONE) >> np.uint64(63) == 1
            joined = ~side[:-1] & side[1:] & ~self._mark[1:] & ~self._mark[:-1]
            at = self._keep(~joined)
            pair = np.append(joined, False)[at]
            after = np.append(self._old, 0)[at + 1].astype(np.uint64)
            self.name = np.where(pair, mix(self._old[at] * _LEFT + after * _RIGHT + np.uint64(r)), self._old[at])

    def _around(self) -> tuple[np.ndarray, np.ndarray]:
        """Per boundary, the words that tell it together with the symbols on both sides."""
        end = np.append(self.start[1:], len(self.words) + 1)
        low = np.minimum(self.low, np.append(self.low[1:], end[-1]))
        high = np.maximum(np.append(self.high[1:], end[-1]), end)
        high = np.maximum(high, self.high)
        low[1:] = np.minimum(low[1:], np.minimum(self.low[:-1], self.start[:-1]))
        high[1:] = np.maximum(high[1:], self.high[:-1])
        low[:1] = -1
        return low, high

    def _keep(self, boundary: np.ndarray) -> np.ndarray:
        low, high = self._around()
        at = np.flatnonzero(np.concatenate([[True], boundary]))
        self._old = self.name
        self.start, self.low, self.high, self._mark = self.start[at], low[at], high[at], self._mark[at]
        return at

    def anchors(self):
        """``(low, high, key, place)`` of each boundary with ``SIDE`` symbols of its document on both sides."""
        low, high = self._around()
        n = max(len(self.name) - 2 * SIDE + 1, 0)
        whole = np.ones(n, bool)
        for j in range(2 * SIDE):
            whole &= ~self._mark[j : j + n]
        at = np.flatnonzero(whole) + SIDE
        key = np.full(len(at), _WHOLE)
        for j in range(-SIDE, SIDE):
            key = mix(key * _LEFT + self.name[at + j])
        near = range(1 - SIDE, SIDE)  # the boundaries between those symbols
        low = np.min([low[at + j] for j in near], axis=0)
        high = np.max([high[at + j] for j in near], axis=0)
        return low, high, key, self.start[at]


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column(rows.schema.get_field_index("doc_id")).fill_null(_NO_ID).to_numpy()
    return ids, rows.column(rows.schema.get_field_index("_row")).to_numpy()


def _valid(first: np.ndarray, size: int, window: int) -> np.ndarray:
    """Places at which a whole window of one document starts."""
    change = np.zeros(size + 1, np.int64)
    n = np.diff(first)
    at = first[:-1] + np.arange(len(n)) + 1
    some = n >= window
    change[at[some]] += 1
    change[at[some] + n[some] - window + 1] -= 1
    return np.cumsum(change)[:size] > 0


def _find(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            ids, numbers = _ids(rows)
            starts, ends, first = words(data, offsets)
            parse = Parse(word_hashes(data, starts, ends), first, rounds)
            low, high, key, place = parse.anchors()
            at, n, anchor = pick_anchors(low, high, key, place, window, _valid(first, len(parse.words), window))
            whole = Rolling(mix(parse.words ^ _WHOLE), 1)
            kf = mix(whole.of(at, at + n - 1 + window) + np.where(anchor < 0, 0, anchor - at).astype(np.uint64))
            key_at = np.zeros(len(parse.words), np.uint64)
            key_at[place] = key
            k = np.where(anchor < 0, mix(kf ^ _ALONE), key_at[anchor])
            doc = np.searchsorted(first[1:] + np.arange(1, len(first)), at, "left")
            begin = first[doc] + doc + 1
            yield contexts(k, kf, ids[doc], numbers[doc], at - begin, n)

    return run


def spans_of(rows: pa.RecordBatch, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the spans a row carries: its place in the step, first window there, and windows."""
    starts, counts = lists(rows, "starts")
    n, _ = lists(rows, "counts")
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc, base[doc] + starts.to_numpy(), n.to_numpy().astype(np.int64)


def _split(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            ids, numbers = _ids(rows)
            starts, ends, first = words(data, offsets)
            doc, at, n = spans_of(rows, first[:-1])
            own = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            two = [Rolling(word_hashes(data, starts, ends, w), w).of(own, own + window) for w in (0, 1)]
            yield windows(*two, ids[doc], numbers[doc], own - first[doc])

    return run


def covered(rows: pa.RecordBatch, base: np.ndarray, size: int, window: int) -> np.ndarray:
    """Which of the step's symbols a span's windows cover."""
    _, at, n = spans_of(rows, base)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n - 1 + window, -1)
    return np.cumsum(change)[:size] > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            _, _, first = words(data, offsets)
            gone = covered(rows, first[:-1], first[-1], window)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            raw, kept = data.tobytes(), []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = raw[a:b].split()
                if removed[i]:
                    own = compress(own, ~gone[first[i] : first[i + 1]])
                kept.append(b" ".join(own))
            yield record(
                {
                    "doc_id": rows.column(rows.schema.get_field_index("doc_id")),
                    "n_words": np.diff(first),
                    "n_removed": removed,
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(_row, starts, counts)``: in each document the runs of windows that also start earlier, in words."""
    rows = numbered(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = stored(rows.mapInArrow(_find(window, rounds_for(window)), CONTEXTS))
    first = stored(open_and_closed(found, True))
    split = rows.join(gathered(first.where("NOT closed")), "_row")
    second = stored(split.mapInArrow(_split(window), CONTEXTS))
    closed = first.where("closed").unionByName(open_and_closed(second, False))
    return stored(gathered(closed.drop("closed")))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row of ``docs`` (a stored table): ``kept`` holds, as
    bytes, the words that no repeated window covers, joined by one space."""
    spans = repeated_windows(docs, window)
    rows = numbered(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    return rows.join(spans, "_row", "left").mapInArrow(_cut(window), schema)
