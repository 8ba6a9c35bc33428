"""Approximate nearest neighbours with one small-world graph per shard.

Equal vectors are one node. Nodes are dealt to shards by a hash; a task builds its shard's
hierarchical navigable small-world graph, kept as flat neighbour arrays, and the shards' answers
to a query are merged by distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.staging import stage

#: Neighbours of a node above the lowest layer (twice as many there), nodes a search keeps open,
#: and nodes of a shard.
LINKS, OPEN, SHARD_NODES = 16, 96, 4096


@dataclass
class Graph:
    """Flat arrays: ``links[layer]`` has a row of node numbers for each node of that layer (-1:
    none), ``row[layer]`` the row of each node."""

    vectors: np.ndarray
    norms: np.ndarray
    links: list[np.ndarray]
    row: list[np.ndarray]
    entry: int


def _nearest_of(vectors: np.ndarray, norms: np.ndarray, members: np.ndarray, most: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """For each member its nearest other members, nearest first, by blocks of distances."""
    v, sq = vectors[members], norms[members]
    most = min(most, len(members) - 1)
    at, dist = np.empty((len(members), most), np.int64), np.empty((len(members), most))
    for a in range(0, len(members), 512):
        b = min(a + 512, len(members))
        d = sq[a:b, None] + sq[None, :] - 2 * (v[a:b] @ v.T)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        part = np.argpartition(d, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(d, part, 1)
        order = np.argsort(near, axis=1, kind="stable")
        at[a:b], dist[a:b] = np.take_along_axis(part, order, 1), np.take_along_axis(near, order, 1)
    return at, dist


def _diverse(vectors: np.ndarray, norms: np.ndarray, near: np.ndarray, dist: np.ndarray,
             most: int) -> list[int]:
    """Neighbours closer to the node than to any neighbour taken before; filled up by distance."""
    v, sq = vectors[near], norms[near]
    between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    taken: list[int] = []
    open_to = np.ones(len(near), bool)
    for i in range(len(near)):
        if open_to[i]:
            taken.append(i)
            if len(taken) == most:
                break
            open_to &= between[i] >= dist
    for i in range(len(near)):
        if len(taken) >= most:
            break
        if i not in taken:
            taken.append(i)
    return near[taken].tolist()


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """The layered graph of a shard. Layers are drawn geometrically; each node links to diverse
    near nodes of its layer, and back from them while their rows have room."""
    vectors = np.asarray(vectors, np.float32)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    n = len(vectors)
    top = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n))
                   / math.log(LINKS)).astype(int)
    links, rows = [], []
    for layer in range(int(top.max()) + 1):
        members = np.flatnonzero(top >= layer)
        most = LINKS * 2 if layer == 0 else LINKS
        row = np.full(n, -1, np.int64)
        row[members] = np.arange(len(members))
        table = np.full((len(members), most), -1, np.int32)
        if len(members) > 1:
            at, dist = _nearest_of(vectors, norms, members, most * 2)
            used = np.zeros(len(members), np.int64)
            chosen = [_diverse(vectors, norms, members[at[i]], dist[i], most // 2)
                      for i in range(len(members))]
            for i, out in enumerate(chosen):
                table[i, :len(out)] = out
                used[i] = len(out)
            for i, out in enumerate(chosen):
                for j in row[out]:
                    if used[j] < most and members[i] not in table[j, :used[j]]:
                        table[j, used[j]] = members[i]
                        used[j] += 1
        links.append(table)
        rows.append(row)
    return Graph(vectors, norms, links, rows, int(np.argmax(top)))


def search(graph: Graph, target: np.ndarray, k: int, keep: int = OPEN) -> np.ndarray:
    """Numbers of about the ``k`` nearest nodes: greedy descent, then a best-first search that
    keeps ``keep`` nodes open on the lowest layer."""
    target = np.asarray(target, np.float32)

    def far(nodes):
        return graph.norms[nodes] - 2 * (graph.vectors[nodes] @ target)

    here, best = graph.entry, float(far([graph.entry])[0])
    for layer in range(len(graph.links) - 1, 0, -1):
        while True:
            near = graph.links[layer][graph.row[layer][here]]
            near = near[near >= 0]
            if not len(near):
                break
            d = far(near)
            i = int(d.argmin())
            if d[i] >= best:
                break
            here, best = int(near[i]), float(d[i])
    keep = max(keep, k)
    seen = np.zeros(len(graph.vectors), bool)
    seen[here] = True
    todo, kept = [(best, here)], [(-best, here)]
    while todo:
        d, node = heapq.heappop(todo)
        if len(kept) >= keep and d > -kept[0][0]:
            break
        near = graph.links[0][node]
        near = near[near >= 0]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        for e, j in zip(far(near).tolist(), near.tolist(), strict=True):
            if len(kept) < keep:
                heapq.heappush(kept, (-e, j))
                heapq.heappush(todo, (e, j))
            elif e < -kept[0][0]:
                heapq.heapreplace(kept, (-e, j))
                heapq.heappush(todo, (e, j))
    return np.array([j for _, j in sorted(kept, reverse=True)][:max(k, keep)])


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows whose vector has only finite components, and not all zero."""
    v = F.col("vec")
    return rows.select(F.col(key).cast("long").alias("id"),
                       F.col(vector).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))


def _nodes(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors with the ``most`` smallest ids of their rows, and their number of rows.

    Ids are merged first within a batch, then by vector and a salt, so a vector that a third of
    all rows share reaches a task as a few short lists.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), {}
            for i in np.argsort(ids, kind="stable").tolist():
                found.setdefault(batch.column(1)[i].as_py(), []).append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.binary()),
                pa.array([sorted(set(x))[:most] for x in found.values()], pa.list_(pa.int64()))],
                ["raw", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())],
                                             ["id", "raw"])

    small = rows.mapInArrow(packed, "id bigint, raw binary").mapInArrow(
        run, "raw binary, ids array<bigint>")
    merge = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    salt = F.pmod(F.xxhash64("ids"), F.lit(16))
    return small.groupBy("raw", salt.alias("salt")).agg(merge.alias("ids")).groupBy("raw").agg(
        merge.alias("ids"))


def _shard_answers(nodes: DataFrame, queries: DataFrame, k: int, shard_nodes: int) -> DataFrame:
    """(query_id, vec_id, score): the best rows of every shard for every query."""
    n = nodes.count()
    shards = max(1, math.ceil(n / shard_nodes))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("raw"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for size, part in left.groupby(left["raw"].str.len()):
            originals = np.frombuffer(b"".join(part["raw"]), "<f8").reshape(len(part), -1)
            graph = build(originals)
            ids = part["ids"].tolist()
            for q, raw in zip(right["id"], right["raw"], strict=True):
                if len(raw) != size:
                    continue
                target = np.frombuffer(raw, "<f8")
                near = search(graph, target, k + 1)
                gap = originals[near] - target
                score = np.sqrt((gap * gap).sum(axis=1))
                best = heapq.nsmallest(k, (
                    (s, int(i)) for s, j in zip(score.tolist(), near.tolist(), strict=True)
                    for i in ids[j] if i != q))
                out["query_id"] += [q] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [s for s, _ in best]
        return pd.DataFrame(out)

    return dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        answer, "query_id bigint, vec_id bigint, score double")


def nearest(rows: DataFrame, queries: DataFrame, *, key: str = "vec_id",
            vector: str = "embedding", k: int = 10, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query row.

    Score is the Euclidean distance in double precision; ranks go by score, then by smaller id.
    A query's own id is no candidate. Null ids and vectors that are null, empty, zero or hold a
    null or non-finite component take no part, as row or query; vectors of another length than
    the query's are never near it. Rows that repeat an id and vector count once; one id with
    several vectors takes its nearest. Empty tables give no rows. A task holds one shard's graph
    (about ``shard_nodes`` vectors) and the query set; no vector is left out of the graphs, and a
    shared vector keeps its ``k + 1`` smallest ids, all that a result can name.
    """
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()],
                pa.binary())], ["id", "raw"])

    nodes = stage(_nodes(usable(rows, key, vector), k + 1), "vectors")
    asked = usable(queries, key, vector).mapInArrow(raw, "id bigint, raw binary").dropDuplicates()
    found = _shard_answers(nodes, asked, k, shard_nodes).groupBy("query_id", "vec_id").agg(
        F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op8_hnsw")
def op8_hnsw(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))
