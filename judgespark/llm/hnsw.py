"""A hierarchical navigable small-world graph in flat arrays, built and searched many points at a time.

Nodes are ordered by level, highest first, so the nodes of level ``l`` are the first ``sizes[l]``, and each
level's links are one ``sizes[l] x width`` array of node numbers, -1 where there is none. The last link of a
node is its bridge, so that a beam as wide as the graph finds every node.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WIDTH, BASE_WIDTH = 16, 32
BUILD_BEAM, BLOCK, STEP = 64, 128, 4
WIDTHS = (BASE_WIDTH + 1, WIDTH + 1)  # stored links of a node: in level 0, above
_FAR = np.inf


class Graph(NamedTuple):
    points: np.ndarray  # nodes x dimensions, components of about 1 or less
    sizes: list[int]  # nodes of each level, from level 0
    links: list[np.ndarray]  # of each level


def _distances(points: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of each row's points to its own target; infinite where there is no point."""
    gap = points[np.maximum(at, 0)] - to[:, None, :]
    out = np.einsum("rcd,rcd->rc", gap, gap)
    out[at < 0] = _FAR
    return out


def search_level(points: np.ndarray, links: np.ndarray, to: np.ndarray, entry: np.ndarray, beam: int, n: int):
    """Beam search of one level for all rows of ``to`` at once: nodes and squared distances, nearest first.

    ``entry`` holds each row's first nodes. Rows go on until their beam has no node left to expand.
    """
    rows = len(to)
    seen = np.zeros((rows, n + 1), bool)  # the last column takes what is no node
    node = np.full((rows, beam), -1, np.int64)
    far = np.full((rows, beam), _FAR)
    done = np.ones((rows, beam), bool)
    found, distance = entry, _distances(points, entry, to)
    seen[np.arange(rows)[:, None], found] = True
    live = np.arange(rows)
    fresh_node, fresh_far = found, distance
    while True:
        all_node = np.concatenate([node[live], fresh_node], 1)
        all_far = np.concatenate([far[live], fresh_far], 1)
        all_done = np.concatenate([done[live], np.zeros(fresh_node.shape, bool)], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        node[live] = np.take_along_axis(all_node, order, 1)
        far[live] = np.take_along_axis(all_far, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(far[live])
        live = live[~done[live].all(1)]
        if not len(live):
            return node, far
        todo = np.argsort(done[live], axis=1, kind="stable")[:, :STEP]  # nearest not yet expanded
        open_ = ~np.take_along_axis(done[live], todo, 1)
        from_ = np.where(open_, np.take_along_axis(node[live], todo, 1), 0)
        marks = done[live]
        np.put_along_axis(marks, todo, True, 1)
        done[live] = marks
        next_ = np.where(open_[:, :, None], links[from_], -1).reshape(len(live), -1)
        known = np.take_along_axis(seen[live], np.where(next_ < 0, n, next_), 1) | (next_ < 0)
        # A node that two expansions of a row share is looked at once.
        order = np.argsort(next_, axis=1, kind="stable")
        ordered = np.take_along_axis(next_, order, 1)
        again = np.zeros(ordered.shape, bool)
        again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        twice = np.empty_like(again)
        np.put_along_axis(twice, order, again, 1)
        next_ = np.where(known | twice, -1, next_)
        seen[live[:, None], np.where(next_ < 0, n, next_)] = True
        fresh_node, fresh_far = next_, _distances(points, next_, to[live])


def choose(points: np.ndarray, near: np.ndarray, far: np.ndarray, width: int) -> np.ndarray:
    """Links of each row among its candidates, nearest first: a candidate that is nearer to a chosen one than to the
    row's own point is left, unless places remain."""
    rows, many = near.shape
    if many <= width:
        out = np.full((rows, width), -1, np.int64)
        out[:, :many] = np.where(np.isfinite(far), near, -1)
        return out
    own = points[np.maximum(near, 0)]
    square = np.einsum("rcd,rcd->rc", own, own)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
    there = np.isfinite(far)
    taken = np.zeros((rows, many), bool)
    blocked = np.full((rows, many), _FAR)  # nearest chosen one to each candidate
    count = np.zeros(rows, np.int64)
    for c in range(many):
        take = there[:, c] & (far[:, c] < blocked[:, c]) & (count < width)
        taken[:, c] = take
        count += take
        blocked[take] = np.minimum(blocked[take], between[take, c])
    rank = np.where(taken, 0, np.where(there, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    picked = np.take_along_axis(near, order, 1)
    return np.where(np.take_along_axis(there, order, 1), picked, -1)


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen nodes to the new ones; full nodes choose again."""
    width = links.shape[1]
    to, of = chosen.ravel(), np.repeat(new, chosen.shape[1])
    of, to = of[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    node, start, count = np.unique(to, return_index=True, return_counts=True)
    more = np.full((len(node), count.max(initial=0)), -1, np.int64)
    more[np.repeat(np.arange(len(node)), count), np.arange(len(to)) - np.repeat(start, count)] = of
    both = np.concatenate([links[node], more], 1)
    full = (both >= 0).sum(1) > width
    order = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
    links[node[~full]] = np.take_along_axis(both, order, 1)[~full]
    for at in range(0, int(full.sum()), 512):
        some = np.flatnonzero(full)[at : at + 512]
        far = _distances(points, both[some], points[node[some]])
        order = np.argsort(far, axis=1, kind="stable")
        links[node[some]] = choose(
            points, np.take_along_axis(both[some], order, 1), np.take_along_axis(far, order, 1), width
        )


def _descend(graph: Graph, level: int, to: np.ndarray) -> np.ndarray:
    """The nearest node to each row that the levels above ``level`` lead to."""
    entry = np.zeros((len(to), 1), np.int64)
    for above in range(len(graph.sizes) - 1, level, -1):
        entry = search_level(graph.points, graph.links[above], to, entry, 8, graph.sizes[above])[0][:, :1]
    return entry


def bridges(points: np.ndarray, links: np.ndarray) -> np.ndarray:
    """One more link of each node, -1 for most: with them every node can be reached from the first.

    Nodes that links do not lead to are hung on the nearest reached node that has no such link yet.
    """
    n = len(points)
    extra = np.full((n, 1), -1, np.int64)
    reached = np.zeros(n, bool)
    for root in range(n):
        if reached[root]:
            continue
        if root:
            free = np.flatnonzero(reached & (extra[:, 0] < 0))
            extra[free[((points[free] - points[root]) ** 2).sum(1).argmin()]] = root
        edge = np.array([root])
        while len(edge):
            reached[edge] = True
            edge = np.unique(links[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
    return extra


def build(points: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, Graph]:
    """The graph of ``points``, whose nodes have the given levels, and the order of its nodes.

    Levels are built from the top, each a block of nodes after another. A block looks for its neighbours
    in what is there, led by the finished level above, and among itself.
    """
    order = np.argsort(-level, kind="stable")
    points = np.ascontiguousarray(points[order], np.float64)
    top = int(level.max(initial=0))
    sizes = [int((level >= l).sum()) for l in range(top + 1)]
    graph = Graph(points, sizes, [np.zeros((0, 0), np.int64)] * (top + 1))
    for l in range(top, -1, -1):
        width = WIDTH if l else BASE_WIDTH
        links = np.full((sizes[l], width), -1, np.int64)
        for a in range(0, sizes[l], BLOCK):
            new = np.arange(a, min(a + BLOCK, sizes[l]))
            own = points[new]
            peers = np.broadcast_to(new, (len(new), len(new))).copy()
            peers[np.arange(len(new))[None, :] >= np.arange(len(new))[:, None]] = -1  # earlier ones
            near, far = peers, _distances(points, peers, own)
            if a:
                entry = _descend(graph, l, own)
                # Nodes of the level above come first here, so the entry is there already if it is before this block.
                entry = np.where(entry < a, entry, 0)
                got = search_level(points, links, own, entry, BUILD_BEAM, sizes[l])
                near, far = np.concatenate([got[0], near], 1), np.concatenate([got[1], far], 1)
            best = np.argsort(far, axis=1, kind="stable")[:, :BUILD_BEAM]
            chosen = choose(points, np.take_along_axis(near, best, 1), np.take_along_axis(far, best, 1), width)
            links[new] = chosen
            _link_back(points, links, new, chosen)
        graph.links[l] = np.concatenate([links, bridges(points[: sizes[l]], links)], 1)
    return order, graph


def search(graph: Graph, to: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers near each row of ``to``, nearest first, -1 where there are fewer than ``beam``."""
    out = np.full((len(to), beam), -1, np.int64)
    for a in range(0, len(to), BLOCK):
        own = np.ascontiguousarray(to[a : a + BLOCK], np.float64)
        entry = _descend(graph, 0, own)
        entry = np.concatenate([entry, np.where(entry > 0, 0, -1)], 1)  # from the first node all others can be reached
        node, far = search_level(graph.points, graph.links[0], own, entry, beam, graph.sizes[0])
        out[a : a + BLOCK] = np.where(np.isfinite(far), node, -1)
    return out
