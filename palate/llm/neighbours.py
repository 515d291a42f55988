"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams.

Vectors are dealt by hash into shards of about ``SHARD_ROWS`` distinct vectors. A shard's graph starts from
random edges and is built in two passes over its vectors, many at a time: a greedy search from the middle finds
each vector's candidates, and robust pruning keeps the nearest, then the next that is not much nearer (by the
factor ``alpha``) to one already kept, up to ``DEGREE`` edges. Edges go back too; a list that would outgrow
``ROOM`` is pruned again. Nodes that no path from the entry leads to then get an edge from the nearest that one does, so a
beam as wide as the shard finds all of it.
A beam search of width ``BEAM`` then answers each query in every shard, and the shards' finds are merged.

Equal vectors are one node of the graph, with its ``k + 1`` smallest ids (a query can drop its own and still
has k), so copies neither crowd the graph nor the beams. All finds are measured again, exactly, in double precision.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components take no part; vectors of
different length are never compared; queries with fewer than k candidates get all of them; ties go to the smaller
vec_id; rows that share a vec_id are candidates each, and a query drops one row only, its own; of several rows with
a query's vec_id the one with the smallest vector asks; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import part_count, read_table, save

DEGREE, ROOM, BEAM, BUILD_BEAM = 24, 48, 96, 56
ALPHA = 1.2
SHARD_ROWS = 16_384
BATCH = 256
QUERY_BLOCK = 2048


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vector double[]) of the vectors that take part."""
    v = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a (n, d) to those of b (n, m, d)."""
    diff = b - a[:, None, :]
    return np.einsum("nmd,nmd->nm", diff, diff)


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, seed: int = 1):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(self.v)
        self.degree = degree
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, ROOM * degree // DEGREE), -1, np.int32)
        if n > 1:
            some = rng.integers(0, n - 1, (n, min(degree, n - 1)))
            self.edges[:, : some.shape[1]] = some + (some >= np.arange(n)[:, None])
        middle = self.v.mean(0)
        self.entry = int(np.argmin(((self.v - middle) ** 2).sum(1))) if n else 0
        order = rng.permutation(n)
        for alpha in (1.0, ALPHA):
            for a in range(0, n, BATCH):
                self._insert(order[a : a + BATCH], alpha)
        self._connect()

    def reached(self) -> np.ndarray:
        """Which nodes the edges lead to from the entry."""
        seen = np.zeros(len(self.v), bool)
        front = np.array([self.entry] if len(self.v) else [], np.int64)
        while len(front):
            seen[front] = True
            ends = self.edges[front].ravel()
            front = np.unique(ends[ends >= 0])
            front = front[~seen[front]]
        return seen

    def _connect(self) -> None:
        """Give every node that no path leads to an edge from its nearest one that a path leads to, in addition to
        the edges there are. Usually there are none such."""
        while not (seen := self.reached()).all():
            lost, known = np.flatnonzero(~seen)[:BATCH], np.flatnonzero(seen)
            best, heads = np.full(len(lost), np.inf), np.zeros(len(lost), np.int64)
            for a in range(0, len(known), BATCH):
                part = known[a : a + BATCH]
                d = distances(self.v[lost], np.broadcast_to(self.v[part], (len(lost), *self.v[part].shape)))
                near = d.argmin(axis=1)
                closer = d[np.arange(len(lost)), near] < best
                best[closer], heads[closer] = d[np.arange(len(lost)), near][closer], part[near[closer]]
            heads, at = np.unique(heads, return_index=True)  # one more edge a node each round
            more = np.full((len(self.v), 1), -1, np.int32)
            more[heads, 0] = lost[at]
            self.edges = np.concatenate([self.edges, more], axis=1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, nearest first, and their squared distances; -1
        and inf where there are none. All queries step together; each expands its nearest open node."""
        q, n = len(queries), len(self.v)
        ids = np.full((q, beam), -1, np.int64)
        far = np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, n), bool)
        ids[:, 0], done[:, 0] = self.entry, False
        far[:, 0] = ((queries - self.v[self.entry]) ** 2).sum(1)
        seen[:, self.entry] = True
        live = np.arange(q)
        while len(live):
            at = np.argmin(np.where(done[live], np.inf, far[live]), axis=1)
            open_ = ~done[live, at]
            live, at = live[open_], at[open_]
            if not len(live):
                break
            done[live, at] = True
            near = self.edges[ids[live, at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            near = np.sort(np.where(fresh, near, -1), axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # a neighbour listed twice in one row counts once
            near = np.maximum(near, 0)
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            d = np.where(fresh, distances(queries[live], self.v[near]), np.inf).astype(np.float32)
            all_d = np.concatenate([far[live], d], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_o = np.concatenate([done[live], ~fresh], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            done[live] = np.take_along_axis(all_o, best, 1) | np.isinf(far[live])
        return ids, far

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> None:
        """Robust pruning: the edges of ``nodes`` become the kept ones of ``candidates`` (-1: none)."""
        candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)[:, ::-1]
        candidates = np.where(np.concatenate([np.zeros((len(nodes), 1), bool), candidates[:, 1:] == candidates[:, :-1]], 1), -1, candidates)
        d = np.where(candidates >= 0, distances(self.v[nodes], self.v[np.maximum(candidates, 0)]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, : 3 * self.degree]
        candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
        c = self.v[np.maximum(candidates, 0)]
        square = np.einsum("nmd,nmd->nm", c, c)
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
        kept = np.full((len(nodes), self.edges.shape[1]), -1, np.int32)
        rows = np.arange(len(nodes))
        alive = np.isfinite(d)
        for k in range(self.degree):
            best = np.argmin(np.where(alive, d, np.inf), axis=1)
            there = alive[rows, best]
            if not there.any():
                break
            kept[there, k] = candidates[rows, best][there]
            alive[rows, best] = False
            alive &= alpha * alpha * between[rows, best] > d
        self.edges[nodes] = kept

    def _insert(self, nodes: np.ndarray, alpha: float) -> None:
        found, _ = self.search(self.v[nodes], BUILD_BEAM)
        self._prune(nodes, np.concatenate([found, self.edges[nodes]], 1), alpha)
        source = np.repeat(nodes, self.degree)
        target = self.edges[nodes, : self.degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else target
        size = np.diff(np.append(first, len(target)))
        backs = np.full((len(first), int(size.max()) if len(size) else 0), -1, np.int64)
        backs[np.repeat(np.arange(len(first)), size), np.arange(len(target)) - np.repeat(first, size)] = source
        heads = target[first]
        old = self.edges[heads]
        backs = np.where((old[:, :, None] == backs[:, None, :]).any(1), -1, backs)  # known already
        full = np.concatenate([old, backs], 1)
        full = np.take_along_axis(full, np.argsort(full < 0, axis=1, kind="stable"), 1)
        room = (full >= 0).sum(1) <= self.edges.shape[1]
        self.edges[heads[room]] = full[room, : self.edges.shape[1]]
        over = np.flatnonzero(~room)
        for a in range(0, len(over), BATCH):
            self._prune(heads[over[a : a + BATCH]], full[over[a : a + BATCH]], alpha)


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, vector, ids): distinct vectors with their k + 1 smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    found = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return found.select(F.size("vector").alias("dim"), "vector", "ids")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def _runs(batches) -> Iterator[tuple[tuple[int, int, bool], pa.RecordBatch]]:
    """The batches cut where (shard, dim, asks) changes."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        a = 0
        for key, rows in groupby(keys):
            n = len(list(rows))
            yield key, batch.slice(a, n)
            a += n


def answers(batches, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) for a stream (shard, dim, asks, vec_id, vector, ids) in which a shard's nodes stand
    before its queries: one shard's graph and at most ``QUERY_BLOCK`` queries are held at a time."""
    at, parts, ids, graph = None, [], [], None
    vectors = np.empty((0, 0))
    for (shard, dim, asks), rows in _runs(batches):
        if at != (shard, dim):
            at, parts, ids, graph, vectors = (shard, dim), [], [], None, np.empty((0, dim))
        if not asks:
            parts.append(_matrix(rows.column(4), dim))
            ids += rows.column(5).to_pylist()
            continue
        if graph is None and parts:
            vectors, parts = np.concatenate(parts), []
            graph = Graph(vectors)
        if graph is None:
            continue
        for a in range(0, len(rows), QUERY_BLOCK):
            part = rows.slice(a, QUERY_BLOCK)
            yield _answer(graph, vectors, ids, part.column(3).to_pylist(), _matrix(part.column(4), dim), k, beam)


def _answer(graph: Graph, vectors: np.ndarray, ids: list[list[int]], asked: list[int], own: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    out = {name: [] for name in ("query_id", "vec_id", "score")}
    found = np.concatenate([graph.search(own[b : b + BATCH].astype(np.float32), beam)[0] for b in range(0, len(own), BATCH)])
    for query, vector, hits in zip(asked, own, found, strict=True):
        left_out = False  # the query's own row
        hits = hits[hits >= 0]
        exact = np.sqrt(((vectors[hits] - vector) ** 2).sum(1))
        order, most = np.argsort(exact, kind="stable"), 0
        pairs = []
        for h in order.tolist():
            if most >= k and exact[h] > pairs[k - 1][0]:
                break
            near = list(ids[hits[h]])
            if not left_out and query in near and np.array_equal(vectors[hits[h]], vector):
                near.remove(query)
                left_out = True
            pairs += [(float(exact[h]), i) for i in near]
            most = len(pairs)
            pairs.sort()
        for score, i in pairs[:k]:
            out["query_id"].append(query)
            out["vec_id"].append(i)
            out["score"].append(score)
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], names=list(out))


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (vec_id, vector) against every vector of ``table``."""
    spark = table.sparkSession
    graph_nodes = save(nodes(usable(table), k), "graph-nodes")
    shards = max(1, -(-graph_nodes.count() // shard_rows))
    dealt = graph_nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    # every query goes to every shard: a stated query set against all rows
    asked = queries.select("vec_id", "vector", F.size("vector").alias("dim"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    stream = dealt.select("shard", "dim", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("vec_id"), "vector", "ids").unionByName(
        asked.select("shard", "dim", F.lit(True).alias("asks"), "vec_id", "vector", F.lit(None).cast("array<long>").alias("ids"))
    )
    # a task meets a shard's nodes first and then its queries, of which it holds one batch at a time
    stream = stream.repartition(max(part_count(spark), shards), "shard", "dim").sortWithinPartitions("shard", "dim", "asks")
    found = stream.mapInArrow(lambda batches: answers(batches, k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def one_each(queries: DataFrame) -> DataFrame:
    """(vec_id, vector): of rows with one vec_id the smallest vector asks."""
    return queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return nearest(table, one_each(usable(table).where(F.col("vec_id") % 100 == 0)))


QUERIES = {"op4_neighbours": op4_neighbours}
ORACLES: dict[str, str] = {}
