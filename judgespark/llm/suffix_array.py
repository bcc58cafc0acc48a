"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np

_WORD = 8


def _words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as numbers in the order of the bytes."""
    view = np.ndarray(len(padded) - _WORD + 1, ">u8", padded.data, strides=(1,))
    return view[at].astype(np.uint64)


def _first(key: np.ndarray) -> np.ndarray:
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return first


def _group(first: np.ndarray) -> np.ndarray:
    """Where the group of each place begins."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first), dtype=np.int32), np.int32(0)))


def _several(first: np.ndarray) -> np.ndarray:
    """The places in groups of more than one."""
    alone = first.copy()
    alone[:-1] &= first[1:]
    return np.flatnonzero(~alone)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first ``depth`` bytes, and the places in that order whose suffix
    shares at least half of them, if ``depth`` is past the first round, with the one before.

    Suffixes start sorted by their first bytes, as many as fit a word when the bytes in use are
    numbered densely. A round doubles the sorted length: within a group, which shares its first
    ``h`` bytes, the group of the suffix ``h`` bytes on is the key. Only groups of several suffixes are
    sorted again. A suffix that ends is smaller than its continuations.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    used = np.zeros(256, bool)
    used[data] = True
    bits = max(int(used.sum()).bit_length(), 1)
    sorted_to = min(63 // bits, depth)
    key, have = (np.cumsum(used) * used)[data].astype(np.uint64), 1
    while have < sorted_to:  # as many again, or the few left, of those that follow
        more = min(have, sorted_to - have)
        next_ = np.zeros(n, np.uint64)
        next_[: max(n - have, 0)] = key[have:] >> np.uint64(bits * (have - more))
        key = (key << np.uint64(bits * more)) | next_
        have += more
    order = np.argsort(key).astype(np.int32)
    first = _first(key[order])
    rank = np.empty(n, np.int32)
    rank[order] = _group(first)
    near, active = np.flatnonzero(~first), _several(first)  # places in the order
    while len(active) and sorted_to < depth:
        who = order[active]
        on = who + np.int32(sorted_to)
        follow = np.where(on < n, rank[np.minimum(on, n - 1)] + np.int32(1), np.int32(0))
        key = (rank[who].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        by = np.argsort(key)
        who = who[by]
        order[active] = who
        first = _first(key[by])
        rank[who] = active[_group(first)]
        sorted_to *= 2
        if sorted_to <= depth:
            near = active[~first]  # sorting again inside a group leaves its places
        active = active[_several(first)]
    return order, near


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, exact below ``limit``.

    Kasai's observation: where the next pair, in the text, is one place on at both sides, its prefix is
    one shorter. So bytes are compared only at the last pair of such a run, and ``limit`` of them.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    order = np.argsort(a)
    a, b = a[order], b[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    last = np.append(np.flatnonzero(head)[1:], len(a)) - 1
    length = np.zeros(len(last), np.int64)
    padded = np.concatenate([data, np.zeros(_WORD, np.uint8)])
    room = len(data) - np.maximum(a[last], b[last])
    todo = np.arange(len(last))
    for done in range(0, limit, _WORD):
        x, y = _words_at(padded, a[last[todo]] + done), _words_at(padded, b[last[todo]] + done)
        differ = x ^ y
        # Equal leading bytes of a word: all but those from the highest set bit down.
        equal = np.where(differ == 0, _WORD, (64 - _bit_length(differ)) // 8)
        length[todo] += equal
        todo = todo[(equal == _WORD) & (room[todo] >= done + _WORD)]
        if not len(todo):
            break
    length = np.minimum(length, room)
    run = np.cumsum(head) - 1
    out = np.empty(len(a), np.int64)
    out[order] = length[run] + (a[last][run] - a)
    return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])


def later_copies(data: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Which valid places start ``width`` bytes that also start at an earlier valid place."""
    late = np.zeros(len(data), bool)
    if len(data) < width:
        return late
    order, near = suffix_array(data, width)
    near = near[common_prefixes(data, order[near], order[near - 1], width) >= width]
    if not len(near):
        return late
    # Runs of neighbours alike are one group; its least valid place is the first.
    head = np.ones(len(near), bool)
    head[1:] = near[1:] != near[:-1] + 1
    heads = np.flatnonzero(head)
    place = np.where(valid, np.arange(len(data)), len(data))
    least = np.minimum(np.minimum.reduceat(place[order[near]], heads), place[order[near[heads] - 1]])
    late[order[near]] = True
    late[order[near[heads] - 1]] = True
    late &= valid
    late[least[least < len(data)]] = False
    return late
