"""Approximate nearest neighbours: a small-world graph per shard, shard results merged.

Vectors are dealt to shards by a hash of their id, so equal vectors spread; a shard has about
``SHARD_ROWS``. Within a shard equal vectors are one node with several ids. Each shard's graph is one stored
row of flat arrays over vectors scaled by a power of two, so vectors of any size keep their order. Queries
stream past every shard; a shard gives its nearest to each query, with exact distances of the original
vectors in double precision, and the shards' answers are ranked.

Null vectors, vectors of zeros or without components, and vectors holding null or non-finite components take no
part, neither do rows without id. Of rows with one id, the one with the least vector counts. Vectors of another
length than the query's are never near it. Fewer candidates than asked for are all returned. Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from judgespark.llm import hnsw
from judgespark.llm.common import mix, stored

SHARD_ROWS, QUERY_BLOCK = 4096, 1024
BEAM = 128
FARTHEST = 400  # a target's exponent, at most, above that of its shard's vectors

_INDEX = "dim int, shard long, ids binary, bounds binary, vectors binary, sizes array<int>, links binary"


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(id, vector, dim)`` of the rows that take part, vectors in double precision."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(good)
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _exponent(vectors: np.ndarray) -> int:
    """The power of two that brings all components below 1."""
    return int(np.frexp(np.abs(vectors).max())[1])


def _lengths(gaps: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without squares that leave the range of doubles."""
    exponent = np.frexp(np.abs(gaps).max(1, initial=0.0))[1]
    return np.ldexp(np.sqrt((np.ldexp(gaps, -exponent[:, None]) ** 2).sum(1)), exponent)


def _shard_index(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["id"].to_numpy()
    vectors = np.stack(rows["vector"].to_list())
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    vectors = vectors + 0.0  # one zero
    key = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    uniform = ((mix(ids[first].view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    level = np.minimum(-np.log(uniform) / np.log(hnsw.WIDTH), 12).astype(np.int64)
    node, graph = hnsw.build(np.ldexp(vectors[first], -_exponent(vectors)), level)
    place = np.empty(len(node), np.int64)
    place[node] = np.arange(len(node))
    of = place[which]
    order = np.argsort(of, kind="stable")  # ids ascend within a node
    bounds = np.searchsorted(of[order], np.arange(len(node) + 1))
    return pd.DataFrame(
        {
            "dim": [vectors.shape[1]],
            "shard": [rows["shard"].iloc[0]],
            "ids": [ids[order].tobytes()],
            "bounds": [bounds.astype(np.int64).tobytes()],
            "vectors": [vectors[first][node].tobytes()],
            "sizes": [graph.sizes],
            "links": [np.concatenate([l.ravel() for l in graph.links]).astype(np.int32).tobytes()],
        }
    )


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One stored row for each shard of ``vectors`` (from :func:`usable`)."""
    shards = max(1, -(-vectors.count() // shard_rows))
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    # Ranges put each shard in a partition of its own; hashes of a few shard numbers would collide.
    dealt = rows.repartitionByRange(4 * shards, "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInPandas(_shard_index, _INDEX))


def _graph(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, hnsw.Graph]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    flat, links, at = np.frombuffer(row["links"], np.int32).astype(np.int64), [], 0
    for level, size in enumerate(row["sizes"]):
        width = hnsw.WIDTHS[min(level, 1)]
        links.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    exponent = _exponent(vectors)
    graph = hnsw.Graph(np.ldexp(vectors, -exponent), list(row["sizes"]), links)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64), vectors, exponent, graph


def _search(graph_row, query_ids: np.ndarray, targets: np.ndarray, k: int, beam: int) -> pd.DataFrame:
    ids, bounds, vectors, exponent, graph = graph_row
    # A target far outside the shard comes nearer in its direction, so that no square overflows.
    own = np.frexp(np.abs(targets).max(1))[1]
    scaled = np.ldexp(targets, -np.maximum(exponent, own - FARTHEST)[:, None])
    out = []
    for query, target, nodes in zip(query_ids, targets, hnsw.search(graph, scaled, beam)):
        nodes = nodes[nodes >= 0]
        score = _lengths(vectors[nodes] - target)
        # More ids of one node than k + 1, the query's own among them, can't be needed.
        many = np.minimum(bounds[nodes + 1] - bounds[nodes], k + 1)
        own = ids[np.repeat(bounds[nodes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        score = np.repeat(score, many)
        score, own = score[own != query], own[own != query]
        best = np.lexsort((own, score))[:k]
        out.append(pd.DataFrame({"query_id": query, "vec_id": own[best], "score": score[best]}))
    return pd.concat(out)


def _stream(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for batch in batches:
            starts = np.flatnonzero(batch["links"].notna().to_numpy())
            for a, b in zip([0, *starts], [*starts, len(batch)]):
                if a < b and batch["links"].iloc[a] is not None:
                    graph = _graph(batch.iloc[a])
                    a += 1
                for c in range(a, b, QUERY_BLOCK):
                    asked = batch.iloc[c : min(c + QUERY_BLOCK, b)]
                    yield _search(graph, asked["id"].to_numpy(np.int64), np.stack(asked["vector"].to_list()), k, beam)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query (from :func:`usable`), itself excluded.

    A shard's graph is moved and opened once; the queries follow it in the order of its partition."""
    shards = index.select("dim", "shard")
    asked = queries.join(shards, "dim").select("dim", "shard", F.lit(1).alias("turn"), "id", "vector")
    both = index.withColumn("turn", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    # Ranges put each shard in a partition of its own; hashes of a few shard numbers would collide.
    dealt = both.repartitionByRange(4 * max(1, shards.count()), "dim", "shard").sortWithinPartitions("dim", "shard", "turn")
    found = dealt.mapInPandas(_stream(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
