"""Packing of token sequences into context windows of several lengths.

A document's tokens beyond whole windows of the longest tier are its tail. Each tail is routed to the
smallest tier that holds it. Tiers are packed from the longest: a window opens with the largest tail of
its tier, and its gap is filled with the largest tails of shorter tiers that fit; the last gap
takes the head of a tail, whose rest goes on as a shorter tail. So every window is full. What is left
at the end of a task is cut at powers of two, which need no padding either. The windows of a block are
dealt to step groups of equal token load, longest first.

The input's partitions are packed on their own, a block of tokens at a time: no shuffle, and memory
is bounded by a block and the longest document. Sequence ids are the task's partition and a
counter, so a recomputed task gives the same ones. Null texts count as empty, each row is packed,
repeated rows too, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from judgespark.llm.common import steps, text_of

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 1 << 20
GROUPS = 8
_KNOWN = 400_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group int"
)


# ASCII and the Latin letters beside it need no rule for composing or classes of characters.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others as letters from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts, as the tokenizer in a file gives them, and then ``end``.

    The tokenizer lowers case, drops white space and cuts a text into runs of letters, digits and runs of
    the rest, so a text's ids are those of its words, and a plain word's those of its runs. Words and
    runs seen before are looked up; a new run goes to the tokenizer's model, any other new word, such as
    one with an apostrophe or a special token, to the whole tokenizer.
    """

    _open: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, path: str, end: int) -> Encoder:
        """One for each worker process, so that tasks share what it knows."""
        if (path, end) not in cls._open:
            cls._open[path, end] = cls(path, end)
        return cls._open[path, end]

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        self._end = np.array([end], np.uint32).tobytes()
        self._words: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
            ids = np.array([t.id for t in self._model.tokenize(written)], np.uint32).tobytes()
            if len(self._pieces) >= _KNOWN:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "'" not in text and "<|" not in text:
            ids = b"".join([self._piece(p) for p in _PIECE.findall(text.lower())])
        else:
            ids = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(self._words) >= _KNOWN:
            self._words.clear()
        self._words[word] = ids
        return ids

    def __call__(self, text: bytes) -> np.ndarray:
        known, learn = self._words.get, self._word
        return np.frombuffer(b"".join([known(w) or learn(w) for w in text.split()]) + self._end, np.uint32)


def pack_block(tails: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool):
    """Pack ``(length, document, start)`` tails. Returns the windows, each ``(size, pieces)``, and the rest.

    Every window is full; the rest is what one window of the longest tier could not fill, or, with
    ``last``, nothing, since it is then cut at powers of two.
    """
    pool = sorted(tails)
    windows = []
    left = sum(t[0] for t in pool)
    for tier in reversed(tiers):
        shorter = max((t for t in tiers if t < tier), default=0)
        while pool and left >= tier and (pool[-1][0] > shorter or tier == tiers[0]):
            gap, pieces = tier, []
            while gap:
                at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    length, doc, start = pool.pop(at)
                    pieces.append((doc, start, length))
                    gap -= length
                else:  # every tail is longer than the gap: the shortest gives its head
                    length, doc, start = pool.pop(0)
                    pieces.append((doc, start, gap))
                    insort(pool, (length - gap, doc, start + gap))
                    gap = 0
            left -= tier
            windows.append((tier, pieces))
    if not last:
        return windows, pool
    while left:
        size = 1 << (left.bit_length() - 1)
        gap, pieces = size, []
        while gap:
            length, doc, start = pool.pop()
            take = min(gap, length)
            pieces.append((doc, start, take))
            if take < length:
                pool.append((length - take, doc, start + take))
            gap -= take
        left -= size
        windows.append((size, pieces))
    return windows, []


def step_groups(sizes: list[int], groups: int) -> list[int]:
    """The step group of each window: longest first, each to the group with the least tokens so far."""
    load, out = [0] * groups, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = g = load.index(min(load))
        load[g] += sizes[i]
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, groups: int = GROUPS) -> DataFrame:
    """One row per piece of a document: where it starts there, its ids' checksum, and its place in a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, top = Encoder.of(tokenizer, end_id), max(tiers)
        first = TaskContext.get().partitionId() << 40
        ids: dict[int, tuple[int, np.ndarray]] = {}  # open documents by number
        tails, windows, tokens, number, sequence = [], [], 0, 0, 0

        def flush(last: bool):
            nonlocal tails, windows, sequence, tokens
            more, tails = pack_block(tails, tiers, last)
            windows += more
            rows = []
            for (size, pieces), group in zip(windows, step_groups([w[0] for w in windows], groups)):
                at = 0
                for doc, start, length in pieces:
                    doc_id, own = ids[doc]
                    crc = zlib.crc32(own[start : start + length].astype("<u4").tobytes())
                    rows.append((doc_id, start, length, crc, len(own), first + sequence, at, size, group))
                    at += length
                sequence += 1
            windows, tokens = [], 0
            open_docs = {t[1] for t in tails}
            for doc in [d for d in ids if d not in open_docs]:
                del ids[doc]
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for rows, data, offsets in steps(batches):
            raw = data.tobytes()
            for doc_id, a, b in zip(rows.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = encode(raw[a:b])
                ids[number] = (doc_id, own)
                whole = len(own) // top * top
                windows += [(top, [(number, s, top)]) for s in range(0, whole, top)]
                if whole < len(own):
                    tails.append((len(own) - whole, number, whole))
                tokens += len(own)
                number += 1
                if tokens >= BLOCK_TOKENS:
                    yield flush(False)
        yield flush(True)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)
