"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are first reduced to different ones, each with its `k + 1` least ids (an exact reduction: more copies can never
be among the k nearest of a query other than themselves). A shard holds up to `shard_size` of them. Its graph is
stored as flat neighbour arrays, one (nodes x links) matrix a layer; nodes stand in order of falling level, so that layer
l is the first n_l of them. Layers are built from the top. The first nodes of a layer are linked by exact products; the others are inserted in
batches: each is searched for in the layers above and in what the layer holds so far, its links are chosen among what that finds and its
batch, thinned so that no link is closer to another link than to its node, and lead both ways; a node that gets more than it has room for chooses anew. So a
node's insertion costs a search, not a pass over its shard. Inner products become distances by
one more coordinate that gives all vectors of a shard the same length.

Queries are searched in blocks in every shard, a beam of `beam` nodes per query moving in step for the whole block; what a
shard finds is scored again in double precision on the original vectors, and the best k of all shards are kept. A search grows with the logarithm of its
shard, but every shard is searched: visiting only the quarter of the shards whose centres are closest loses four of ten neighbours on vectors without clusters, as
`embeddings` are, and the closer half still loses 15 %. Shards are as large as a worker's memory holds for that reason.

Edge cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities take no part, nor do rows without an
id or vectors whose dimension is not the commonest one (ties: the larger); a query never finds its own id; ids that occur
with several vectors keep their best score; fewer candidates than k give them all; ties go to the smaller id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viatica.llm.base import cut, table


def _layer(x: np.ndarray, links: int, pool: int) -> np.ndarray:
    """Neighbours of each row of x (unit-like vectors), -1 where there are fewer."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, links), -1, np.int32)
    if n < 2:
        return out
    near = np.empty((n, pool), np.int32)
    for at in range(0, n, 1024):
        sims = x[at : at + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        part = np.argpartition(-sims, pool - 1, 1)[:, :pool] if pool < n else np.argsort(-sims, 1)[:, :pool]
        order = np.argsort(-np.take_along_axis(sims, part, 1), 1, kind="stable")
        near[at : at + len(sims)] = np.take_along_axis(part, order, 1)
    half = links // 2
    kept = np.zeros((n, pool), bool)
    for at in range(0, n, 512):
        own = near[at : at + 512]
        vectors = x[own]
        to_node = np.einsum("bcd,bd->bc", vectors, x[at : at + len(own)])
        between = np.einsum("bcd,bed->bce", vectors, vectors)
        take = np.zeros(own.shape, bool)
        for c in range(pool):
            closer = (between[:, c, :] > to_node[:, c, None]) & take
            take[:, c] = ~closer.any(1) & (take.sum(1) < half)
        kept[at : at + len(own)] = take
    source, place = np.nonzero(kept)
    target = near[source, place]
    # the links found, then those that lead back, then the nearest of the rest, until a row is full
    rest_source, rest_place = np.nonzero(~kept)
    a = np.concatenate([source, target, rest_source])
    b = np.concatenate([target, source, near[rest_source, rest_place]])
    kind = np.repeat([0, 1, 2], [len(source), len(source), len(rest_source)])
    rank = np.concatenate([place, place, rest_place])
    order = np.lexsort((rank, kind, a))
    a, b = a[order], b[order]
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    first.sort()
    a, b = a[first], b[first]
    column = np.arange(len(a)) - np.searchsorted(a, a)
    fits = column < links
    out[a[fits], column[fits]] = b[fits]
    return out


def _thinned(x: np.ndarray, rows: np.ndarray, found: np.ndarray, most: int, links: int, block: int = 512) -> np.ndarray:
    """For nodes `rows`, up to `links` of those found for each (-1 is none): first, nearest first, up to `most` of which none is closer to one before it than to the node; then the nearest of the rest."""
    out = np.full((len(rows), links), -1, np.int32)
    for at in range(0, len(rows), block):
        own, cand = rows[at : at + block], found[at : at + block]
        vectors = x[np.maximum(cand, 0)]
        near = np.einsum("bcd,bd->bc", vectors, x[own])
        near[cand < 0] = -np.inf
        order = np.argsort(-near, 1, kind="stable")
        cand, near, vectors = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(vectors, order[:, :, None], 1)
        between = vectors @ vectors.transpose(0, 2, 1)
        take = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            closer = (between[:, c, :] > near[:, c, None]) & take
            take[:, c] = ~closer.any(1) & (take.sum(1) < most) & (cand[:, c] >= 0)
        rank = np.where(take, 0, np.where(cand >= 0, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        order = np.argsort(rank, 1)[:, :links]
        out[at : at + block, : order.shape[1]] = np.take_along_axis(cand, order, 1)
    return out


class Graph:
    def __init__(self, vectors: np.ndarray, ids: list[list[int]], links: int = 16, pool: int = 48, first: int = 8192):
        """vectors: one row per different vector, ids: its least ids."""
        draw = np.array([xxhash.xxh64_intdigest(v.tobytes(), 7) for v in vectors], np.float64) / 2**64
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.vectors, self.ids, level = vectors[order], [ids[i] for i in order], level[order]
        x = self.vectors.astype(np.float32)
        squares = (x * x).sum(1)
        self.x = np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1)
        tops = [n for n in (int((level >= lv).sum()) for lv in range(int(level.max()) + 1)) if n]
        self.layers: list[np.ndarray] = []
        for lv in range(len(tops) - 1, -1, -1):
            self.layers.insert(0, self._grown(tops[lv], links * (2 if lv == 0 else 1), pool, first))

    def _grown(self, n: int, links: int, pool: int, first: int) -> np.ndarray:
        """One more layer, of the first n nodes, below those there are."""
        out = np.full((n, links), -1, np.int32)
        at = min(n, first)
        out[:at] = _layer(self.x[:at], links, pool)
        while at < n:
            new = np.arange(at, min(n, at + first, at + at // 2))
            own = self.x[new]
            found = np.concatenate([self._beam(own[i : i + 256], out[:at], self._entries(own[i : i + 256], at, pool), pool) for i in range(0, len(new), 256)])
            sims = own @ own.T
            np.fill_diagonal(sims, -np.inf)
            few = min(pool // 2, len(new) - 1)
            beside = np.argpartition(-sims, few - 1, 1)[:, :few] + at if few else np.zeros((len(new), 0), int)
            out[new, : links // 2] = _thinned(self.x, new, np.concatenate([np.where(found < at, found, -1), beside], 1), links // 2, links // 2)
            self._lead_back(out, new, links)
            at += len(new)
        return out

    def _entries(self, queries: np.ndarray, below: int, beam: int) -> np.ndarray:
        """Where to begin in a layer that holds the nodes below `below`: what the layers above find, and the highest nodes."""
        top = np.tile(np.arange(min(below, 8), dtype=np.int32), (len(queries), 1))
        if not self.layers:
            return top
        found = self._descend(queries, 0, 16)[:, : beam - top.shape[1]]
        found = np.where(found < below, found, below).astype(np.int32)
        found[(found[:, :, None] == top[:, None, :]).any(2)] = below
        return np.concatenate([top, found], 1)

    def _lead_back(self, out: np.ndarray, new: np.ndarray, links: int) -> None:
        """Links back to the new nodes from those they lead to."""
        source, place = np.nonzero(out[new] >= 0)
        to, back = out[new][source, place], new[source]
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[to], self.x[back]), to))
        to, back = to[order], back[order]
        rows, begin = np.unique(to, return_index=True)
        column = np.arange(len(to)) - np.repeat(begin, np.diff(np.r_[begin, len(to)]))
        keep = column < links
        more = np.full((len(rows), int(column[keep].max()) + 1), -1, np.int32)
        more[np.searchsorted(rows, to[keep]), column[keep]] = back[keep]
        both = np.concatenate([out[rows], more], 1)
        both.sort(1)
        both = both[:, ::-1].copy()
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # a link that leads there already
        both.sort(1)
        both = both[:, ::-1]
        counts = (both >= 0).sum(1)
        fits = counts <= links
        out[rows[fits]] = np.pad(both[fits][:, :links], ((0, 0), (0, max(0, links - both.shape[1]))), constant_values=-1)
        full = np.flatnonzero(~fits)
        if len(full):
            out[rows[full]] = _thinned(self.x, rows[full], both[full][:, : int(counts.max())], links, links)

    def _beam(self, queries: np.ndarray, layer: np.ndarray, start: np.ndarray, beam: int, at_once: int = 4) -> np.ndarray:
        n, m = len(queries), len(layer)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, m + 1), bool)  # the last column stands for no node
        seen[:, m] = True
        nodes = np.full((n, beam), m, np.int32)
        nodes[:, : start.shape[1]] = start
        seen[rows, nodes] = True
        x = self.x
        sims = np.full((n, beam), -np.inf, np.float32)
        sims[:, : start.shape[1]] = np.einsum("bmd,bd->bm", x[np.minimum(start, m - 1)], queries)
        sims[nodes == m] = -np.inf
        done = ~np.isfinite(sims)
        live = np.arange(n)
        while len(live):
            waiting = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-waiting, min(at_once, beam - 1), 1)[:, :at_once]
            valid = np.isfinite(np.take_along_axis(waiting, pick, 1))
            go = valid.any(1)
            live, pick, valid = live[go], pick[go], valid[go]
            if not len(live):
                break
            inner = np.arange(len(live))[:, None]
            done[live[:, None], pick] = True
            centres = np.where(valid, nodes[live[:, None], pick], m)
            found = np.where(centres[:, :, None] < m, layer[np.minimum(centres, m - 1)], -1).reshape(len(live), -1)
            found = np.where(found < 0, m, found)
            found.sort(1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = m
            found[seen[live[:, None], found]] = m
            seen[live[:, None], found] = True
            near = np.einsum("bmd,bd->bm", x[np.minimum(found, m - 1)], queries[live]).astype(np.float32)
            near[found == m] = -np.inf
            all_nodes = np.concatenate([nodes[live], found.astype(np.int32)], 1)
            all_sims = np.concatenate([sims[live], near], 1)
            all_done = np.concatenate([done[live], ~np.isfinite(near)], 1)
            best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            nodes[live], sims[live], done[live] = all_nodes[inner, best], all_sims[inner, best], all_done[inner, best]
        order = np.argsort(-sims, 1, kind="stable")
        return np.where(np.isfinite(np.take_along_axis(sims, order, 1)), np.take_along_axis(nodes, order, 1), m)

    def _descend(self, queries: np.ndarray, to: int, beam: int) -> np.ndarray:
        """What the layers find from the top down to layer `to`, nearest first."""
        top = self.layers[-1]
        start = np.tile(np.arange(min(len(top), beam), dtype=np.int32), (len(queries), 1))
        for lv in range(len(self.layers) - 1, to - 1, -1):
            layer = self.layers[lv]
            found = self._beam(queries, layer, start, max(start.shape[1], beam))
            start = np.where(found < len(layer), found, len(self.layers[lv - 1]) if lv else len(self.x)).astype(np.int32)
        return start

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query's position, id, inner product) of the k best found in this shard."""
        for at in range(0, len(queries), 256):
            block = queries[at : at + 256]
            q = np.concatenate([block.astype(np.float32), np.zeros((len(block), 1), np.float32)], 1)
            if len(self.layers) > 1:
                start = self._descend(q, 1, min(beam, 24))
            else:
                start = np.tile(np.arange(min(len(self.x), beam), dtype=np.int32), (len(block), 1))
            start = self._beam(q, self.layers[0], start, max(start.shape[1], beam))
            for i in range(len(block)):
                nodes = start[i][start[i] < len(self.x)]
                scores = self.vectors[nodes] @ block[i]
                rows = sorted((-s, v) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for v in self.ids[node] if v != own[at + i])
                yield from ((at + i, v, -s) for s, v in rows[:k])


def valid_vectors(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(vec_id, v) with v as doubles, of `size` numbers, or as many as most vectors have."""
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    good = good.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return good.filter(F.size("v") == (common_size(good) if size is None else size))


def common_size(good: DataFrame) -> int:
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return most[0] if most else 0


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, shard_size: int = 16_384, beam: int = 128, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries among rows (vec_id, embedding)."""
    good = cut(valid_vectors(rows))
    size = common_size(good)
    ranked = good.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    different = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    shards = max(1, math.ceil(different.count() / shard_size))
    asked = cut(valid_vectors(queries, size).distinct())
    blocks = max(1, math.ceil(asked.count() / block))

    def build(_, held: pa.Table) -> pa.Table:
        column = held.column("v").combine_chunks()
        vectors = column.flatten().to_numpy().reshape(len(column), -1)
        graph = Graph(vectors, held.column("ids").to_pylist())
        return pa.table({"shard": held.column("shard").slice(0, 1), "graph": pa.array([pickle.dumps(graph)], pa.binary())})

    index = different.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(lambda key, t: build(key, t), "shard int, graph binary")
    index = cut(index)

    def search(key, graphs: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if graphs.num_rows and held.num_rows:
            graph = pickle.loads(graphs.column("graph")[0].as_py())
            column = held.column("v").combine_chunks()
            own = held.column("vec_id").to_numpy()
            found = graph.search(column.flatten().to_numpy().reshape(len(column), -1), own, k, beam)
            out = [(own[i], v, s) for i, v, s in found]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))
