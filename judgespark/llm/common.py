"""Shared helpers: scratch tables, joins that survive hot keys, and text as bytes in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one numpy step holds; a longer document makes a step of its own.
STEP_BYTES = 4 << 20
# A key is hot above this many rows and above this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1_000, 0.001

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no earlier stage again."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for this table is not needed again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lookup(big: DataFrame, small: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has one row per ``key`` and, in ``rows``, its rows in ``big``.

    Keys above ``HOT_SHARE`` of all rows are broadcast (at most ``1 / HOT_SHARE`` of them, by the
    pigeonhole principle); all others meet in a shuffle where no key is large.
    """
    total = small.agg(F.coalesce(F.sum(rows), F.lit(0))).scalar()
    hot = small.where((F.col(rows) > HOT_ROWS) & (F.col(rows) > total * F.lit(HOT_SHARE)))
    cold = small.where(~((F.col(rows) > HOT_ROWS) & (F.col(rows) > total * F.lit(HOT_SHARE))))
    with_hot = big.join(F.broadcast(hot), key, "inner")
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key, how)
    return with_hot.unionByName(rest)


# ---- text in numpy -------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))  # odd, so they have inverses
_POWERS_STEP = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n + 1`` of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = (n // _POWERS_STEP + 1) * _POWERS_STEP
        base = int(_BASE[which])
        have = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            have.append(np.cumprod(p))
        _POWERS[which] = have = tuple(have)
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols, equal for equal stretches."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self._down = powers(len(symbols), which)
        self._sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + length)

    def every(self, size: int) -> np.ndarray:
        """The hashes of all stretches of one size, as :meth:`of` gives them."""
        n = max(len(self._sums) - size, 0)
        length = np.uint64(size * 0xA24BAED4963EE407 % 2**64)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n] + length)


def byte_symbols(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLE[which][data]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[data]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES):
    """``(rows, data, offsets)`` for stretches of rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        kind, width = column.type, np.int32
        if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            width = np.int64
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def inside_words(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of a word."""
    return _WORD[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of words before each document."""
    inside = _WORD[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    after[:-1] = inside
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SEEDS = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B], np.uint64)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit names of words: eight bytes after eight are mixed in, so words of up to eight bytes and one length never
    share a name, and no kind of pattern does; words above 64 bytes have a keyed digest."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    out = mix(size.astype(np.uint64) ^ _SEEDS[which])
    at, some = starts, np.flatnonzero(size <= _LONG_WORD)
    left = size
    while len(some):
        out[some] = mix(out[some] ^ (eights[at[some]] & _LOW[np.minimum(left[some], 8)]))
        at, left = at + 8, left - 8
        some = some[left[some] > 0]
    long = np.flatnonzero(size > _LONG_WORD)
    if len(long):
        key = int(_SEEDS[which]).to_bytes(8, "little")
        digests = [blake2b(data[a:b].tobytes(), digest_size=8, key=key).digest() for a, b in zip(starts[long], ends[long])]
        out[long] = np.frombuffer(b"".join(digests), "<u8")
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, the same at every scan of a stored table."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def record(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def lists(rows: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column (null as empty) and how many each row has."""
    held = rows.column(rows.schema.get_field_index(column))
    counts = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return held.flatten(), counts
