"""Graph search: navigable graphs in shards of bounded size.

Vectors are dealt by hash to as many shards as ``shard_rows`` asks for; each shard's graph is
built by one task and searched by one task, and shards' results meet in a top-k.
``by_centroids`` puts each vector into the shards of its nearest centroids instead; a shard over
its capacity is divided by hash, so that no task gets more. ``merged`` unites their graphs into one
table of nodes, which ``beam_search`` walks: the driver holds each query's list, and every round
fetches the neighbours and codes of the nodes to expand that it has not met before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.operators.knn import centroid_sets
from nearfield.operators.scan import Entry, entries_of, matrix
from nearfield.operators.topk import top_k

SHARD_ROWS = 50_000
FETCHED, KEPT = 20_000, 100_000  # rows that a walk fetches in a job, and keeps for later rounds


def greedy(x: np.ndarray, edges: list[np.ndarray], start: int, q: np.ndarray, width: int, kernel) -> tuple[list[tuple[float, int]], list[int]]:
    """Best-first search with a list of ``width``: (nearest found, expanded)."""
    pool = [(float(kernel(q, x[start : start + 1])[0]), start)]
    expanded: list[int] = []
    done, seen = set(), {start}  # what fell out of the list once would again
    while True:
        at = next((i for _, i in pool if i not in done), None)
        if at is None:
            return pool, expanded
        done.add(at)
        expanded.append(at)
        new = [n for n in dict.fromkeys(edges[at].tolist()) if n not in seen]
        if new:
            seen.update(new)
            pool.extend(zip(kernel(q, x[new]).tolist(), new, strict=True))
            pool.sort()
            del pool[width:]


def prune(x: np.ndarray, p: int, near: list[int], degree: int, alpha: float, kernel) -> np.ndarray:
    """Neighbours of p, none of which a nearer one covers: occluded where alpha times its distance to a kept one is less."""
    left = np.array(sorted(set(near) - {p}), np.int64)
    d = kernel(x[p], x[left])
    order = np.lexsort((left, d))
    left, d = left[order], d[order]
    v, kept = x[left], []
    while len(left) and len(kept) < degree:
        kept.append(left[0])
        clear = np.flatnonzero(alpha * kernel(v[0], v[1:]) > d[1:]) + 1
        left, d, v = left[clear], d[clear], v[clear]
    return np.array(kept, np.int64)


def vamana(x: np.ndarray, degree: int = 24, width: int = 50, alpha: float = 1.2, kernel=metrics.KERNELS["squared_euclidean"]) -> tuple[list[np.ndarray], int]:
    """A graph of one layer and its start, the vector nearest to the mean: two passes of search, pruning and reverse edges."""
    n = len(x)
    start = int(kernel(x.mean(axis=0), x).argmin())
    rng = np.random.default_rng(7)
    edges = [rng.choice(n, min(degree, n), replace=False) for _ in range(n)]
    for a in (1.0, alpha):
        for p in rng.permutation(n).tolist():
            _, seen = greedy(x, edges, start, x[p], width, kernel)
            edges[p] = prune(x, p, [*seen, *edges[p].tolist()], degree, a, kernel)
            for n2 in edges[p].tolist():
                if p not in edges[n2]:
                    edges[n2] = np.append(edges[n2], p)
                    if len(edges[n2]) > 1.3 * degree:
                        edges[n2] = prune(x, n2, edges[n2].tolist(), degree, a, kernel)
    return edges, start


def hnsw(x: np.ndarray, degree: int = 16, width: int = 100, scale: int = 16, kernel=metrics.KERNELS["squared_euclidean"]) -> tuple[list[list[np.ndarray]], int]:
    """Layers of neighbour lists (lowest first) and the entry. Levels come from a hash of the row."""
    n = len(x)
    u = np.random.default_rng(11).random(n)
    level = np.floor(-np.log(u) / np.log(scale)).astype(int)
    layers = [[np.zeros(0, np.int64) for _ in range(n)] for _ in range(level.max(initial=0) + 1)]
    entry = 0
    for p in range(1, n):
        at = entry
        for k in range(level[entry], -1, -1):
            found, _ = greedy(x, layers[k], at, x[p], width if k <= level[p] else 1, kernel)
            if k <= level[p]:
                most = degree * 2 if k == 0 else degree
                own = prune(x, p, [i for _, i in found], degree, 1.0, kernel)
                layers[k][p] = own
                for n2 in own.tolist():
                    layers[k][n2] = np.append(layers[k][n2], p)
                    if len(layers[k][n2]) > most:
                        layers[k][n2] = prune(x, n2, layers[k][n2].tolist(), most, 1.0, kernel)
            at = found[0][1]
        if level[p] > level[entry]:
            entry = p
    return layers, entry


def _graph(kind: str, x: np.ndarray, options: dict):
    """(layers from the top, start)."""
    if kind == "vamana":
        edges, start = vamana(x, **options)
        return [edges], start
    layers, entry = hnsw(x, **options)
    return layers[::-1], entry


def sharded(base: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    n = max(1, -(-base.count() // shard_rows))
    return base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n)))


def build(base: DataFrame, kind: str = "vamana", **options) -> DataFrame:
    """(shard, layer, vec_id, nbrs, start) of the shards of ``base`` (shard, vec_id, v)."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("vec_id").sort_values("vec_id")
        ids, x = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
        layers, start = _graph(kind, x, options)
        out = [(int(key[0]), k, int(ids[p]), ids[e].tolist(), int(ids[start])) for k, edges in enumerate(layers) for p, e in enumerate(edges) if len(e) or k == len(layers) - 1]
        return pd.DataFrame(out, columns=["shard", "layer", "vec_id", "nbrs", "start"])

    return base.select("shard", "vec_id", "v").groupBy("shard").applyInPandas(one, "shard long, layer int, vec_id long, nbrs array<long>, start long")


def _shard_search(ids: np.ndarray, q: np.ndarray, k: int, width: int, kernel):
    def one(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("vec_id").sort_values("vec_id")
        names, x = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
        layers = []
        for _, part in links.groupby("layer"):
            e = [np.zeros(0, np.int64)] * len(names)
            for p, n in zip(np.searchsorted(names, part["vec_id"]), part["nbrs"], strict=True):
                e[p] = np.searchsorted(names, n)
            layers.append(e)
        start, found = int(np.searchsorted(names, links["start"].iloc[0])), []
        for i in range(len(ids)):
            at = start
            for e in layers:
                got, _ = greedy(x, e, at, q[i], width if e is layers[-1] else 1, kernel)
                at = got[0][1]
            found += [(int(ids[i]), int(names[p]), d) for d, p in got[:k]]
        return pd.DataFrame(found, columns=["qid", "vec_id", "dist"])

    return one


def search(base: DataFrame, edges: DataFrame, queries: DataFrame, k: int, width: int = 100, metric: str = "squared_euclidean") -> DataFrame:
    """(qid, vec_id, dist, rk): greedy searches in each shard, the k nearest of all. k is ``width`` at most."""
    kernel, k = metrics.KERNELS[metric], min(k, width)
    asked = entries_of(queries, k)
    one = _shard_search(np.array([e.pool for e in asked], np.int64), np.array([e.vector for e in asked]), k, width, kernel)
    out = base.select("shard", "vec_id", "v").groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(one, "qid long, vec_id long, dist double")
    best = out.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"))
    return top_k(best, k, ["qid"])


def by_centroids(base: DataFrame, centroids: DataFrame, copies: int = 2, capacity: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, v, shard): each vector in the shards of its ``copies`` nearest centroids, a stated table; shards of
    more than ``capacity`` rows are divided by hash."""
    labels, c = centroid_sets(centroids)[0]
    copies = min(copies, len(labels))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                near = labels[np.argsort(d, axis=1, kind="stable")[:, :copies]]
                at = pa.array(np.repeat(np.arange(len(x)), copies))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel())], names=["vec_id", "v", "label"])

    rows = base.where(F.col("v").isNotNull()).select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, label long")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().toLocalIterator()}
    parts = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, -(-n // capacity)))) if sizes else F.lit(None)
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(parts, F.col("label"))) if sizes else F.lit(0)
    return rows.select("vec_id", "v", (F.col("label") * (1 << 20) + part).alias("shard"))


def merged(edges: DataFrame, degree: int) -> DataFrame:
    """(vec_id, nbrs): the union of a vector's neighbours in all shards, the first ``degree`` by hash."""
    every = edges.select("vec_id", F.explode("nbrs").alias("n")).distinct()
    picked = top_k(every.withColumn("dist", F.xxhash64("n")), degree, ["vec_id"], key="n")
    return picked.groupBy("vec_id").agg(F.sort_array(F.collect_list("n")).alias("nbrs"))


def nodes(base: DataFrame, edges: DataFrame, degree: int) -> DataFrame:
    """(vec_id, nbrs, v): the merged graph with whole vectors, one row a node."""
    return base.select("vec_id", "v").dropDuplicates(["vec_id"]).join(merged(edges, degree), "vec_id", "left").select("vec_id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"), "v")


class _Rows:
    """Arrays of a table by vec_id, fetched in one job for ``FETCHED`` of them; the first ``KEPT`` stay on the driver."""

    def __init__(self, table: DataFrame, column: str):
        self.table, self.column, self.known = table, column, {}

    def __call__(self, ids: list[int]) -> dict[int, np.ndarray]:
        out = {i: self.known[i] for i in ids if i in self.known}
        left = [i for i in ids if i not in out]
        for a in range(0, len(left), FETCHED):
            wanted = self.table.sparkSession.createDataFrame([(i,) for i in left[a : a + FETCHED]], "vec_id long")
            got = {r[0]: np.array(r[1], np.int64) for r in self.table.join(F.broadcast(wanted), "vec_id").select("vec_id", self.column).collect()}
            out |= got
            self.known.update(list(got.items())[: max(0, KEPT - len(self.known))])
        return out


def beam_search(graph: DataFrame, coded: DataFrame, entries: list[Entry], starts: list[int], centres: np.ndarray, k: int, width: int = 100, beam: int = 4, rounds: int = 200) -> DataFrame:
    """(qid, vec_id, dist, rk): a walk over a merged graph by distances from product codes, several starts, ``beam``
    nodes a query and round, and an exact re-rank of each query's list of ``width``. The lists (queries x width) are
    the driver's; graph and codes stay tables, best written by vec_id, and are joined with the round's ids."""
    from nearfield.operators import pq

    spark, k = graph.sparkSession, min(k, width)
    luts = {e.pool: pq.table(e.vector, centres) for e in entries}
    neighbours, codes = _Rows(graph, "nbrs"), _Rows(coded, "codes")
    pools: dict[int, dict[int, float]] = {e.pool: {} for e in entries}
    done: dict[int, set] = {e.pool: set() for e in entries}

    def offer(wanted: dict[int, list[int]]) -> None:
        ids = sorted({i for w in wanted.values() for i in w})
        if ids:
            got = codes(ids)
            for q, own in wanted.items():
                own = [i for i in own if i in got]
                if own:
                    pools[q].update(zip(own, pq.gathered(luts[q], np.array([got[i] for i in own])).tolist(), strict=True))
                    pools[q] = dict(sorted(pools[q].items(), key=lambda p: (p[1], p[0]))[:width])

    offer({q: starts for q in pools})
    for _ in range(rounds):
        front = {q: [i for i in pool if i not in done[q]][:beam] for q, pool in pools.items()}
        ids = sorted({i for f in front.values() for i in f})
        if not ids:
            break
        near = {i: n.tolist() for i, n in neighbours(ids).items()}
        for q, f in front.items():
            done[q].update(f)
        offer({q: sorted({n for i in f for n in near.get(i, ())} - done[q] - set(pools[q])) for q, f in front.items()})
    found = spark.createDataFrame([(q, i) for q, pool in pools.items() for i in pool], "pool long, vec_id long")
    ranked = pq.refine(found, graph, entries, k, metrics.KERNELS["squared_euclidean"])
    return ranked.withColumnRenamed("pool", "qid")
