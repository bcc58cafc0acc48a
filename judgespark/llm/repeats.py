"""Windows of a sequence that also occur earlier, found through contexts of shared anchors.

A step of the corpus describes its windows as *contexts*: runs of neighbouring windows that chose the same
anchor. ``k`` names the anchor by its content, ``kf`` the whole context. Windows with equal content
choose anchors of equal name, so

* of contexts with equal ``(k, kf)``, all but the first hold only windows that occur earlier;
* a first context can hold such windows only if its ``k`` has several ``kf``. Its windows are
  then compared one by one.

Contexts repeated within a step are closed there, so a group of equal contexts has one row for each step
at most. An anchor with very many different contexts is dealt out by context, and all of its
contexts go on to the second comparison.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgespark.llm.common import HOT_ROWS, HOT_SHARE, mix, record, signed

CONTEXTS = "k long, kf long, doc_id long, _row long, start int, n int, heavy int"
CLOSED = -1


def contexts(k, kf, doc, row, start, n):
    """The rows of one step: equal contexts but the first are closed, closed neighbours are joined.

    ``heavy`` is the number of open contexts of an anchor, stated once, where it is a large share of the
    step's. A share of all rows that large is reached in some step.
    """
    order = np.lexsort((start, row, doc, kf, k))
    k, kf, doc, row, start, n = (x[order] for x in (k, kf, doc, row, start, n))
    first_k = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    first = first_k.copy()
    first[1:] |= kf[1:] != kf[:-1]
    at = np.flatnonzero(first)
    group = np.cumsum(first_k)[at] - 1
    size = np.bincount(group, minlength=0) if len(at) else np.zeros(0, np.int64)
    heavy = np.where(first_k[at], size[group], 0)
    heavy[heavy < max(2, HOT_SHARE * len(at))] = 0
    late = np.flatnonzero(~first)
    late = late[np.lexsort((start[late], row[late]))]
    r, s, m = row[late], start[late], n[late]
    head = np.ones(len(late), bool)
    head[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + m[:-1])
    heads = np.flatnonzero(head)
    total = np.add.reduceat(m, heads) if len(heads) else np.zeros(0, m.dtype)
    late = late[heads]
    pick = np.concatenate([at, late])
    return record(
        {
            "k": signed(k[pick]),
            "kf": signed(kf[pick]),
            "doc_id": doc[pick],
            "_row": row[pick],
            "start": start[pick].astype(np.int32),
            "n": np.concatenate([n[at], total]).astype(np.int32),
            "heavy": np.concatenate([heavy, np.full(len(late), CLOSED)]).astype(np.int32),
        }
    )


def windows(f, g, doc, row, start):
    """The rows of one step for single windows; ``heavy`` tells the closed ones, again joined."""
    return contexts(f, g, doc, row, start, np.ones(len(start), np.int64))


def open_and_closed(found: DataFrame, split: bool, by_range: bool = False) -> DataFrame:
    """``(_row, start, n, closed)`` of contexts that are closed, or, with ``split``, must be compared window
    by window; the others hold no window that occurs earlier. Equal anchors meet by hash or, with
    ``by_range``, in sorted ranges: the range of a row is found by binary search among the bounds."""
    live, done = found.where(f"heavy != {CLOSED}"), found.where(f"heavy = {CLOSED}")
    if split:
        total = live.agg(F.count(F.lit(1))).scalar()
        hot = live.where("heavy > 0").groupBy("k").agg(F.sum("heavy").alias("_n"))
        hot = hot.where((F.col("_n") > HOT_ROWS) & (F.col("_n") > total * F.lit(HOT_SHARE))).select("k", F.lit(True).alias("hot"))
        live = live.join(F.broadcast(hot), "k", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        live = live.withColumn("p", F.when(F.col("hot"), F.xxhash64("k", "kf")).otherwise(F.col("k")))
    else:
        live = live.withColumns({"p": F.col("k"), "hot": F.lit(False)})
    live = live.drop("heavy")
    live = live.repartitionByRange("p") if by_range else live.repartition("p")
    by_anchor = Window.partitionBy("p", "k")
    by_context = Window.partitionBy("p", "k", "kf").orderBy("doc_id", "_row", "start")
    live = live.withColumn("nth", F.row_number().over(by_context))
    if split:
        live = live.withColumn("several", F.col("hot") | (F.min("kf").over(by_anchor) != F.max("kf").over(by_anchor)))
        live = live.where("nth > 1 OR several")
    else:
        live = live.where("nth > 1")
    live = live.select("_row", "start", "n", (F.col("nth") > 1).alias("closed"))
    return live.unionByName(done.select("_row", "start", "n", F.lit(True).alias("closed")))


def gathered(spans: DataFrame) -> DataFrame:
    """``(_row, starts, counts)``: the spans of each document, as many as its text has room for."""
    both = F.array_sort(F.collect_list(F.struct("start", "n")))
    out = spans.groupBy("_row").agg(both.alias("s"))
    return out.select("_row", F.col("s.start").alias("starts"), F.col("s.n").alias("counts"))


def pick_anchors(low: np.ndarray, high: np.ndarray, key: np.ndarray, place: np.ndarray, width: int, valid: np.ndarray):
    """Contexts of one step: ``(first window, windows, place of the anchor or -1)``.

    An anchor at ``place`` is known from the symbols ``[low, high)``. Each window takes the
    least of the anchors it can tell, by a hash of their names; without one it stands alone.
    """
    best = np.full(len(valid), np.iinfo(np.uint64).max, np.uint64)
    rank = (mix(key) >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
    reach = low - high + width + 1
    fits = reach > 0
    low, rank, reach = low[fits], rank[fits], reach[fits]
    first, last = np.maximum(low - reach + 1, 0), low
    # Least of the intervals [first, last] that cover a window: a sparse table, filled downwards.
    levels = max(int(reach.max()).bit_length(), 1) if len(reach) else 1
    table = np.full((levels, len(valid)), np.iinfo(np.uint64).max, np.uint64)
    if len(reach):
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for q in range(levels):
            at = level == q
            np.minimum.at(table[q], first[at], rank[at])
            np.minimum.at(table[q], last[at] - (1 << q) + 1, rank[at])
        for q in range(levels - 1, 0, -1):
            half = 1 << (q - 1)
            np.minimum(table[q - 1], table[q], out=table[q - 1])
            np.minimum(table[q - 1][half:], table[q][: len(valid) - half], out=table[q - 1][half:])
    best = table[0]
    at = np.flatnonzero(valid)
    chosen = best[at]
    alone = chosen == np.iinfo(np.uint64).max
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (chosen[1:] != chosen[:-1]) | alone[1:]
    heads = np.flatnonzero(head)
    n = np.diff(np.append(heads, len(at)))
    anchor = np.where(alone[heads], -1, (chosen[heads] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return at[heads], n, anchor


