"""Approximate nearest neighbours by inner product: one HNSW graph for each shard, flat arrays throughout.

Nodes are a shard's distinct vectors, and near is what has a large inner product, while linking as while
searching: so the long vectors, which are most queries' answers, are what nodes link to. Each node draws a level; layer l
holds the nodes of level l and up. Layers are built from the top, nodes in batches: a batch searches
the layer as it stands, from where the layer above leads, chooses diverse neighbours and is linked
both ways. A layer is one array of neighbours, -1 where there are fewer. The index is a table, a row
a shard, that is written to the shared folder and searched by blocks of queries.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.llm.shared import materialize
from trellis.llm.vectors import by_blocks, dealt, matrix, pairs_to_best, ranked, rows_within, usable

SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
#: Neighbours of a node above layer 0 and in it; breadth of the search while building and when asked.
M, M0, EF_BUILD, EF_SEARCH = 16, 32, 64, 160
#: So many first nodes of a layer are linked by comparing all of them; nodes of a batch; nodes opened at a time.
FIRST, BATCH, WIDE = 1_024, 512, 4
#: A search begins from so many of the longest vectors too.
LONGEST = 16


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes that a best-first search finds for each query, nearest first: numbers (-1:
    none) and similarities. entry: a node for each query, or a row of different ones (-1: none)."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    entry = entry.reshape(n, -1)[:, :ef]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # where there is no neighbour
    found = np.full((n, ef), -1)
    near, opened = np.full((n, ef), -np.inf, x.dtype), np.zeros((n, ef), bool)
    begin = np.where(entry < 0, -np.inf, np.matmul(x[entry], queries[:, :, None])[:, :, 0])
    order = np.argsort(-begin, axis=1, kind="stable")
    found[:, : entry.shape[1]], near[:, : entry.shape[1]] = np.take_along_axis(entry, order, 1), np.take_along_axis(begin, order, 1)
    seen[rows, entry] = True
    live = np.arange(n)
    while len(live):
        # the nearest that aren't opened yet; what isn't there counts as opened
        rank = np.where(opened[live] | (found[live] < 0), ef, np.arange(ef))
        at = np.sort(rank, axis=1)[:, :WIDE]
        going = at[:, 0] < ef
        live, at = live[going], at[going]
        if not len(live):
            break
        real = at < ef
        at = np.minimum(at, ef - 1)
        nodes = np.where(real, found[live[:, None], at], -1)
        i, j = np.nonzero(real)
        opened[live[i], at[i, j]] = True
        next_ = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        next_ = next_.astype(np.int64)
        # of a neighbour that several of the opened nodes have, one stays
        next_ = np.sort(next_, axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
        fresh = ~seen[live[:, None], next_]
        seen[live[:, None], next_] = True
        seen[:, -1] = True
        width = int(fresh.sum(1).max(initial=0))
        if not width:
            continue
        pick = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        next_ = np.where(np.take_along_axis(fresh, pick, 1), np.take_along_axis(next_, pick, 1), -1)
        similar = np.matmul(x[next_], queries[live][:, :, None])[:, :, 0]
        similar[next_ < 0] = -np.inf
        every_near, every = np.concatenate([near[live], similar], 1), np.concatenate([found[live], next_], 1)
        every_open = np.concatenate([opened[live], np.zeros_like(next_, bool)], 1)
        order = np.argsort(-every_near, axis=1, kind="stable")[:, :ef]
        near[live], found[live], opened[live] = (np.take_along_axis(a, order, 1) for a in (every_near, every, every_open))
    return found, near


def diverse(x: np.ndarray, own: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of each row of ``nodes`` (-1: none), at most ``most``, nearest first to the vector in ``own``: those nearer
    to it than to any chosen before, then the nearest of the others."""
    similar = np.matmul(x[nodes], own[:, :, None])[:, :, 0]
    similar[nodes < 0] = -np.inf
    order = np.argsort(-similar, axis=1, kind="stable")
    nodes, similar = np.take_along_axis(nodes, order, 1), np.take_along_axis(similar, order, 1)
    v = x[nodes]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen, count = np.zeros(nodes.shape, bool), np.zeros(len(nodes), int)
    closest = np.full(nodes.shape, -np.inf, x.dtype)  # to any chosen
    for j in range(nodes.shape[1]):
        take = (nodes[:, j] >= 0) & (similar[:, j] > closest[:, j]) & (count < most)
        chosen[:, j], count = take, count + take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(nodes < 0, 2, np.where(chosen, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    picked = np.take_along_axis(nodes, order, 1)
    return np.pad(picked, ((0, 0), (0, most - picked.shape[1])), constant_values=-1)


def build_layer(x: np.ndarray, entry: np.ndarray, most: int) -> np.ndarray:
    """Links of the nodes 0 .. len(x) - 1 of a layer, and a last row without any; entry: where each one's
    search starts."""
    n = len(x)
    links = np.full((n + 1, most), -1, np.int32)
    first = min(n, FIRST)
    for at in range(0, first, 256):
        rows = np.arange(at, min(at + 256, first))
        similar = x[rows] @ x[:first].T
        similar[np.arange(len(rows)), rows] = -np.inf
        nearest = np.argsort(-similar, axis=1, kind="stable")[:, : min(EF_BUILD, first - 1)]
        links[rows] = diverse(x, x[rows], nearest, most) if first > 1 else -1
    at = first
    while at < n:
        rows = np.arange(at, min(n, at + min(BATCH, at)))
        start = np.where(entry[rows] < at, entry[rows], 0)
        found, _ = beam(x, links, x[rows], start, EF_BUILD)
        links[rows] = chosen = diverse(x, x[rows], found, most)
        # the other way: each chosen node gets the new ones, and keeps the diverse among all it then has
        to, new = chosen.ravel(), np.repeat(rows, most)
        to, new = to[to >= 0], new[chosen.ravel() >= 0]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        heads, begun, sizes = np.unique(to, return_index=True, return_counts=True)
        added = np.full((len(heads), int(sizes.max(initial=0))), -1)
        added[np.repeat(np.arange(len(heads)), sizes), np.arange(len(to)) - np.repeat(begun, sizes)] = new
        for lo in range(0, len(heads), BATCH):
            part = slice(lo, lo + BATCH)
            # of very many new ones the nearest count, as many again as a search looks at
            every = np.concatenate([links[heads[part]], added[part]], 1)
            if every.shape[1] > most + EF_BUILD:
                similar = np.where(every >= 0, np.matmul(x[every], x[heads[part]][:, :, None])[:, :, 0], -np.inf)
                every = np.take_along_axis(every, np.argsort(-similar, axis=1)[:, : most + EF_BUILD], 1)
            links[heads[part]] = diverse(x, x[heads[part]], every, most)
        at += len(rows)
    return links


class Graph:
    """x: the nodes' vectors, highest level first; layers: neighbours by layer, 0 first."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    def entries(self, queries: np.ndarray, above: int) -> np.ndarray:
        """Where the layers above layer ``above`` lead each query."""
        at = np.zeros(len(queries), np.int64)
        for layer in range(len(self.layers) - 1, above, -1):
            links = self.layers[layer]
            at = beam(self.x[: len(links) - 1], links, queries, at, 1 if layer > 1 else 8)[0][:, 0]
        return at


def levels(n: int, seed: int) -> np.ndarray:
    """Numbers of nodes in each layer, 0 first; the nodes of a layer are the first so many."""
    drawn = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
    return np.array([(drawn >= level).sum() for level in range(drawn.max(initial=0) + 1)])


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """The graph of distinct vectors of one length, in an order that is by chance."""
    graph = Graph(x, [])
    sizes = [s for s in levels(len(x), seed) if s]
    done: list[np.ndarray] = []
    for layer in range(len(sizes) - 1, -1, -1):
        graph.layers = [np.zeros((1, M), np.int32)] * (layer + 1) + done
        n = sizes[layer]
        entry = np.concatenate([graph.entries(x[i : min(n, i + BATCH)], layer) for i in range(0, n, BATCH)])
        done = [build_layer(x[:n], entry, M if layer else M0), *done]
    graph.layers = done
    return graph


def build_index(rows: DataFrame, shards: int, width: int) -> DataFrame:
    """rows: id, v. A row a shard: ids and vectors (distinct, in the graph's order), how many ids each has, sizes
    of the layers, links; all as bytes."""
    ship(rows.sparkSession)

    def make(key: tuple, table: pa.Table) -> pa.Table:
        ids, vectors = matrix(table, "id", "v", width)
        distinct, back = np.unique(vectors, axis=0, return_inverse=True)
        order = np.random.default_rng(1).permutation(len(distinct))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        node = place[back.ravel()]
        by_node = np.lexsort((ids, node))
        distinct = distinct[order]
        most = np.abs(distinct).max()
        x = distinct / most  # so that squares stay finite
        reach = np.linalg.norm(x, axis=1).max()
        x = (x / reach).astype(np.float32)
        graph = build(x)
        put = {"ids": ids[by_node].astype(np.int64), "vectors": distinct, "counts": np.bincount(node, minlength=len(distinct)).astype(np.int64), "x": x}
        put |= {"sizes": np.array([len(a) - 1 for a in graph.layers], np.int64), "links": np.concatenate([a[:-1].ravel() for a in graph.layers]).astype(np.int32)}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in put.items()}})

    schema = "shard int, ids binary, vectors binary, counts binary, x binary, sizes binary, links binary"
    return rows.withColumn("shard", dealt("id", shards, 1)).groupBy("shard").applyInArrow(make, schema)


def search_index(index: DataFrame, queries: DataFrame, k: int, shards: int, blocks: int, width: int, ef: int = EF_SEARCH) -> DataFrame:
    """queries: id, v. query_id, vec_id and score of each shard's k nearest."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, asked = matrix(right, "id", "v", width)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and len(query_ids):
            get = lambda name, kind: np.frombuffer(left.column(name)[0].as_py(), kind)
            counts, sizes, ids = get("counts", np.int64), get("sizes", np.int64), get("ids", np.int64)
            vectors, x = get("vectors", np.float64).reshape(-1, width), get("x", np.float32).reshape(-1, width)
            flat, layers, at = get("links", np.int32), [], 0
            for layer, n in enumerate(sizes):
                w = M if layer else M0
                layers.append(np.concatenate([flat[at : at + n * w].reshape(n, w), np.full((1, w), -1, np.int32)]))
                at += n * w
            graph = Graph(x, layers)
            turned = (asked / np.maximum(np.linalg.norm(asked / (m := np.abs(asked).max(1, keepdims=True)), axis=1, keepdims=True) * m, 1e-300)).astype(np.float32)
            begun = np.cumsum(counts) - counts
            for lo in range(0, len(asked), BATCH):
                part = slice(lo, min(len(asked), lo + BATCH))
                q, mine = turned[part], query_ids[part]
                found, _ = beam_on(graph, q, ef)
                few = (found >= 0).sum(1) < min(k + 1, len(x))
                at = found >= 0
                at[few] = False
                pieces = [(np.nonzero(at)[0], found[at])]
                # a graph in pieces: all nodes for these queries, so many pairs at a time
                other, step = np.flatnonzero(few), max(1, (1 << 22) // (len(x) * width))
                pieces = chain(pieces, ((np.repeat(some, len(x)), np.tile(np.arange(len(x)), len(some))) for some in (other[i : i + step] for i in range(0, len(other), step))))
                for row, node in pieces:
                    # of ids with one vector the smallest count, one more as one may be the query's own
                    take = np.minimum(counts[node], k + 1)
                    row, at_ = np.repeat(row, take), np.repeat(begun[node], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                    scores = np.einsum("ij,ij->i", asked[part][row], vectors[np.repeat(node, take)])
                    keep = ids[at_] != mine[row]
                    row, at_, scores = row[keep], at_[keep], scores[keep]
                    best = pairs_to_best(row, ids[at_], scores, k)
                    out = [np.concatenate(p) for p in zip(out, (mine[row[best]], ids[at_[best]], scores[best]), strict=True)]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return by_blocks(index, queries, blocks, shards, "id", search, "query_id long, vec_id long, score double")


def beam_on(graph: Graph, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """A search of layer 0 from where the layers above lead and from the LONGEST longest vectors: where lengths differ
    much, the best of a query are mostly among those."""
    led = graph.entries(queries, 0)[:, None]
    most = np.argsort(-np.einsum("ij,ij->i", graph.x, graph.x), kind="stable")[:LONGEST]
    long = np.broadcast_to(most, (len(queries), len(most)))
    return beam(graph.x, graph.layers[0], queries, np.concatenate([led, np.where(long == led, -1, long)], 1), ef)


def nearest(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: for each row that is_query holds for, k other rows
    whose inner product with it, in doubles on the vectors as they are, is about the largest; ties
    to the smaller id; all, if fewer.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part. Of rows that repeat an id the least vector counts. Vectors shorter than the longest
    are taken to end in zeros. Equal vectors are one node. Without queries, or in an empty table,
    there are no rows. Only the id and the vector are read."""
    live = usable(vector) & F.exists(F.col(vector), lambda x: x != 0) & F.col(key).isNotNull()
    rows = rows.where(live).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    width = width or 1
    shards, blocks = max(1, -(-total // rows_within(shard_rows, width))), max(1, -(-asked // rows_within(block_rows, width)))
    index = materialize(build_index(rows.select("id", "v"), shards, width), "hnsw")
    return ranked(search_index(index, rows.where("asks").select("id", "v"), k, shards, blocks, width, ef), k)
