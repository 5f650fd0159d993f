"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import settle, store


@dataclass(frozen=True)
class GraphOptions:
    """k: neighbours returned; degree: edges kept by pruning; beam: length of the search lists for building
    and searching; relax: factor by which a kept neighbour must be nearer than the point to prune;
    shard: vectors of a graph; block: queries packed together; blocks: blocks that share a copy of a graph;
    step: nodes expanded at once."""

    k: int = 10
    degree: int = 32
    beam: int = 64
    search_beam: int = 128
    relax: float = 1.2
    shard: int = 8192
    block: int = 1024
    blocks: int = 16
    step: int = 4


class Graph:
    """A directed graph over distinct vectors with edges to near and diverse others."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int):
        self.vectors, self.edges, self.start = vectors, edges, start

    def beam_search(self, queries: np.ndarray, beam: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of each query's ``beam`` nearest met, nearest first; -1 where fewer were met."""
        b, n = len(queries), len(self.vectors)
        ids = np.full((b, beam), -1, np.int64)
        far = np.full((b, beam), np.inf)
        ids[:, 0] = self.start
        far[:, 0] = ((queries - self.vectors[self.start]) ** 2).sum(axis=1)
        opened = np.zeros((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)
        seen[:, self.start] = True
        rows = np.arange(b)
        while rows.size:
            waiting = np.where(opened[rows] | (ids[rows] < 0), np.inf, far[rows])
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :step]
            left = np.take_along_axis(waiting, pick, axis=1)
            busy = np.isfinite(left[:, 0])
            rows, pick, left = rows[busy], pick[busy], left[busy]
            if not rows.size:
                break
            opened[rows[:, None], pick] |= np.isfinite(left)
            node = np.where(np.isfinite(left), np.take_along_axis(ids[rows], pick, axis=1), -1)
            near = np.where(node[:, :, None] >= 0, self.edges[np.maximum(node, 0)], -1).reshape(len(rows), -1)
            near = np.where(seen[rows[:, None], near], -1, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[rows[:, None], near] = True
            seen[:, -1] = False
            r, c = np.nonzero(near >= 0)
            gap = np.full(near.shape, np.inf)
            d = queries[rows[r]] - self.vectors[near[r, c]]
            gap[r, c] = np.einsum("ij,ij->i", d, d)
            all_ids = np.concatenate((ids[rows], near), axis=1)
            all_far = np.concatenate((far[rows], gap), axis=1)
            all_open = np.concatenate((opened[rows], np.zeros(near.shape, bool)), axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[rows], far[rows], opened[rows] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_far, all_open))
        return ids, far


def robust_prune(vectors: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """(points, degree) of kept candidates, -1 filled.

    Nearest first, a candidate is kept unless one kept before is nearer to it by the
    factor ``relax`` than the point is. Slots of -1 and the point itself are no candidates.
    """
    safe = np.maximum(candidates, 0)
    x = vectors[safe]
    gap = np.where((candidates < 0) | (candidates == of[:, None]), np.inf, ((x - vectors[of][:, None, :]) ** 2).sum(axis=2))
    order = np.argsort(gap, axis=1, kind="stable")
    candidates, gap = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(gap, order, axis=1)
    x = np.take_along_axis(x, order[:, :, None], axis=1)
    alive = np.isfinite(gap)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((len(of), degree), -1, np.int64)
    factor, rows = relax * relax, np.arange(len(of))
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, slot] = candidates[some, first[some]]
        between = ((x - x[rows, first][:, None, :]) ** 2).sum(axis=2)
        alive &= ~((factor * between <= gap) & some[:, None])
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray, options: GraphOptions = GraphOptions()) -> Graph:
    """Inserts the vectors in batches that double: a greedy search proposes neighbours, pruning keeps diverse ones, edges are made both ways and pruned where too many."""
    n, room = len(vectors), options.degree + options.degree // 2
    edges = np.full((n, room), -1, np.int64)
    start = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = Graph(vectors, edges, start)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        found, _ = graph.beam_search(vectors[batch], options.beam, options.step)
        kept = robust_prune(vectors, batch, found, options.degree, options.relax)
        edges[batch, : options.degree] = kept
        edges[batch, options.degree :] = -1
        r, c = np.nonzero(kept >= 0)
        to, back = kept[r, c], batch[r]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (edges[nodes] >= 0).sum(axis=1)
        place = np.arange(len(to)) - np.repeat(first, count) + np.repeat(have, count)
        fits = np.repeat(have + count <= room, count)
        edges[to[fits], place[fits]] = back[fits]
        full = np.flatnonzero(have + count > room)
        for part in np.array_split(full, max(1, len(full) // 128)):
            if part.size:
                width = room + int(count[part].max())
                options_of = np.full((len(part), width), -1, np.int64)
                for i, j in enumerate(part):
                    own = np.concatenate((edges[nodes[j]][: have[j]], back[first[j] : first[j] + count[j]]))
                    options_of[i, : len(own)] = own
                edges[nodes[part]] = -1
                edges[nodes[part], : options.degree] = robust_prune(vectors, nodes[part], options_of, options.degree, options.relax)
        at += len(batch)
        size = min(size * 2, 512)
    return graph


def _scale(x: np.ndarray) -> float:
    """A power of two that keeps squares of such vectors finite and above zero."""
    most = float(np.abs(x).max(initial=0.0))
    return 2.0 ** -math.frexp(most)[1] if most > 1e150 or 0 < most < 1e-150 else 1.0


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", options: GraphOptions = GraphOptions()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance.

    is_query is a condition on the id. Vectors are dealt by a hash of their id to
    shards of a bounded size; each shard is a graph of its own, built in one task
    and written as one row. Queries go in blocks to every shard; a task's group is one graph and a few
    blocks, so its memory is bounded, and the best k of all shards are merged. Distances are computed in double
    precision on the stored vectors, scaled by a power of two where squares would overflow; ties go to the smaller id. Equal vectors of a
    shard are one node with all their ids, so copies neither hide each other nor
    cost edges.

    Vectors that are null, empty, zero, or hold a null or non-finite component take
    no part. Only vectors of the query's length are its candidates. Of rows that repeat
    an id the least vector counts. A table with one vector gives no rows. Extra columns are ignored.
    """
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector_col, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = store(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    shards = max(1, math.ceil(rows.count() / options.shard))

    def packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = table.column("v").combine_chunks()
        return table.column("id").to_numpy(), np.asarray(x.flatten()).reshape(table.num_rows, -1)

    def index(key, table):
        ids, x = packed(table)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        distinct, inverse = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(inverse))))
        graph = build(distinct * _scale(distinct), options)
        blobs = [ids[by], ends, distinct, graph.edges.astype(np.int32)]
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "start": [graph.start], **{n: [np.ascontiguousarray(b).tobytes()] for n, b in zip(("ids", "ends", "nodes", "edges"), blobs, strict=True)}}, schema=index_schema)

    index_schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("start", pa.int64()), *((n, pa.binary()) for n in ("ids", "ends", "nodes", "edges"))])
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)))
    graphs = store(sharded.groupBy("dim", "shard").applyInArrow(index, "dim int, shard long, start long, ids binary, ends binary, nodes binary, edges binary"))

    asked = rows.where(is_query(F.col("id")))
    blocks = max(1, math.ceil(asked.count() / options.block))

    def pack(key, table):
        ids, x = packed(table)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "asked": pa.array([ids.tobytes()], pa.binary()), "points": pa.array([x.tobytes()], pa.binary())})

    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks))).groupBy("dim", "block").applyInArrow(pack, "dim int, block long, asked binary, points binary"))

    def search(key, table):
        dim, out = key[0].as_py(), []
        held = np.asarray(table.column("asked").is_null())
        if not held.any() or held.all():
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row = {c: table.column(c)[int(held.argmax())].as_py() for c in ("start", "ids", "ends", "nodes", "edges")}
        ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        nodes = np.frombuffer(row["nodes"]).reshape(-1, dim)
        scale = _scale(nodes)
        nodes = nodes * scale
        graph = Graph(nodes, np.frombuffer(row["edges"], np.int32).reshape(len(nodes), -1).astype(np.int64), row["start"])
        for at in np.flatnonzero(~held).tolist():
            queries = np.frombuffer(table.column("asked")[at].as_buffer(), np.int64)
            points = np.frombuffer(table.column("points")[at].as_buffer()).reshape(-1, dim) * scale
            for lo in range(0, len(queries), 256):
                found, _ = graph.beam_search(points[lo : lo + 256], options.search_beam, options.step)
                for q, x, near in zip(queries[lo : lo + 256], points[lo : lo + 256], found, strict=True):
                    near = near[near >= 0]
                    score = np.sqrt(((nodes[near] - x) ** 2).sum(axis=1)) / scale
                    # of a node's ids the first k + 1 are enough, one may be the query's own
                    own = [(s, i) for s, v in zip(score, near, strict=True) for i in ids[ends[v] : min(ends[v + 1], ends[v] + options.k + 1)] if i != q]
                    out += [(q, i, s) for s, i in sorted(own)[: options.k]]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    last = (blocks - 1) // options.blocks
    copies = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    sent = asked.withColumn("part", F.floor(F.col("block") / options.blocks).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    both = copies.unionByName(sent.drop("block"), allowMissingColumns=True).select("dim", "shard", "part", "start", "ids", "ends", "nodes", "edges", "asked", "points")
    found = both.groupBy("dim", "shard", "part").applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= options.k).select("query_id", "rank", "vec_id", "score")
