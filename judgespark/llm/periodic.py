"""Stretches of words that repeat with a short period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``times`` periods and ``least``
words, which no neighbouring word extends. One pass over a document keeps the lags under which the words so far agree
with earlier ones, and by how many words: an earlier occurrence of the word at hand lengthens its lag by
one, a lag that is not lengthened ends, and if its length suffices its run is emitted there and then.

Earlier occurrences are thinned before the pass, without losing a run. A run with period ``q`` agrees with itself
over ``(times - 1) * q`` words at least, so an occurrence can count only if the next ``G`` words agree as well, where
``G`` is what the shortest lag of its class needs. Lags up to ``G / 2 + 1`` make a class: if such a stretch
of ``G`` words also occurs nearer, both lags are periods of it, hence their greatest common divisor is one of the
whole run (Fine and Wilf), and the longer lag is nobody's smallest period. So each word has at
most one occurrence in each of some ``log(n)`` classes, also where a word repeats a million times.

Words are compared as themselves, by their place in a dictionary; stretches of words by names that
are given by sorting pairs of names of halves. Nothing is shuffled. Null and empty texts have no words and no runs;
repeated rows are treated each; a null id stays null; an empty table gives no rows; other columns are not
read. A text is held whole by its task, with some twenty bytes a word beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from judgespark.llm.common import inside_words, record, steps, text_of, words

LEAST, TIMES = 6, 4

Run = tuple[int, int, int]

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _needed(lag: int, least: int, times: int) -> int:
    """Words that must agree with those ``lag`` before them."""
    return max(least - lag, (times - 1) * lag, 1)


def lag_classes(most: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """``(shortest, longest, G)`` of the classes of lags up to ``most``."""
    if times < 4:
        raise ValueError("a run has four periods at least")
    low = 1
    while low <= most:
        gram, high = _needed(low, least, times), low
        while high < most and high + 1 <= min(gram, _needed(high + 1, least, times)) // 2 + 1:
            high += 1
            gram = min(gram, _needed(high, least, times))
        yield low, high, gram
        low = high + 1


class _Names:
    """Names of all stretches of a size in a sequence, equal just for equal stretches."""

    def __init__(self, symbols: np.ndarray):
        self._levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]

    def of(self, size: int) -> np.ndarray:
        """Two overlapping stretches of the largest power of two name any size."""
        level = size.bit_length() - 1
        while len(self._levels) <= level:
            half = 1 << (len(self._levels) - 1)
            self._levels.append(np.unique(self._pair(self._levels[-1], half), return_inverse=True)[1].astype(np.int64))
        return self._pair(self._levels[level], size - (1 << level))

    @staticmethod
    def _pair(names: np.ndarray, apart: int) -> np.ndarray:
        if not apart:
            return names
        return names[: len(names) - apart] * (int(names.max(initial=0)) + 1) + names[apart:]


def occurrences(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, lag, G)`` of the earlier occurrences that can be part of a run, by place."""
    n = len(symbols)
    most, names, found = n // times, _Names(symbols), []
    for low, high, gram in lag_classes(most, least, times):
        if gram > n - low:
            break
        name = names.of(gram)
        order = np.argsort(name, kind="stable")
        again = name[order[1:]] == name[order[:-1]]
        place, lag = order[1:][again], (order[1:] - order[:-1])[again]
        if not (lag <= most).any():  # longer stretches do not repeat either
            break
        here = (lag >= low) & (lag <= high)
        found.append((place[here], lag[here], np.full(here.sum(), gram)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    place, lag, gram = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(place, kind="stable")
    return place[order], lag[order], gram[order]


def find_runs(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """``(start, length, period)`` of all runs, by start, then period."""
    place, lag, gram = occurrences(symbols, least, times)
    runs: list[Run] = []
    active: dict[int, tuple[int, int, int]] = {}  # lag: its first place, how often lengthened, G

    def end(q: int, first: int, count: int, size: int):
        agreeing = count + size - 1
        if agreeing >= _needed(q, least, times):
            runs.append((first - q, agreeing + q, q))

    at, now = -2, {}
    for i, q, size in zip(place.tolist(), lag.tolist(), gram.tolist()):
        if i != at:
            for ended in active.keys() - now.keys():
                end(ended, *active[ended])
            active, now = now, {}
            if i != at + 1:
                for ended, held in active.items():
                    end(ended, *held)
                active = {}
            at = i
        first, count, _ = active.get(q, (i, 0, 0))
        now[q] = (first, count + 1, size)
    for ended in active.keys() - now.keys():
        end(ended, *active[ended])
    for ended, held in now.items():
        end(ended, *held)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words without what is between them, and each word's place in a dictionary."""
    packed = data[inside_words(data)]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    return packed, column.dictionary_encode().indices.to_numpy()


def joined(packed: np.ndarray, size: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """One string a document: its kept words joined by one space.

    Words stand without gaps in ``packed``, have ``size`` bytes, and document ``d`` has those from ``first[d]`` on.
    """
    before = np.concatenate([[0], np.cumsum(keep)])
    bounds = before[first]  # of the kept words of each document
    room = size[keep] + 1
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    room[last] -= 1  # no space after a document's last word
    at = np.concatenate([[0], np.cumsum(room)])
    out = np.full(at[-1], 0x20, np.uint8)
    written = np.ones(len(out), bool)
    spaced = np.ones(len(room), bool)
    spaced[last] = False
    written[at[1:][spaced] - 1] = False
    out[written] = packed[np.repeat(keep, size)]
    offsets = at[bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs``: its words, its runs by start and period, and ``collapsed``, the words joined by one
    space without those that any run holds after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            starts, ends, first = words(data, offsets)
            packed, symbol = _symbols(data, starts, ends)
            keep = np.ones(len(starts), bool)
            found = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                runs = find_runs(symbol[a:b], least, times)
                for start, length, period in runs:
                    keep[a + start + period : a + start + length] = False
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield record(
                {
                    "doc_id": rows.column(0),
                    "n_words": np.diff(first),
                    "runs": pa.array(found, kind),
                    "collapsed": joined(packed, ends - starts, first, keep),
                }
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)
