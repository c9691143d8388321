"""Exact neighbours and nearest centroids, as scans in numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.operators.scan import entries_of, matrix, scan
from nearfield.operators.topk import top_k

CENTROIDS = 2048  # centroids that are compared with a batch at once
PAIRS = 32_768  # of rows and centroids whose exact distance is taken at once


def exact(base: DataFrame, queries: DataFrame, k: int, metric: str = "squared_euclidean", key: str = "vec_id", vec: str = "v", qkey: str = "qid", qvec: str = "qv", kernel=None, kind=float) -> DataFrame:
    """(qid, key, dist, rk) of the k nearest vectors of every query, a stated set that comes to the driver in full.
    ``kernel`` may be any function of the user's; ``metric`` may differ from query to query through a column ``metric``."""
    if "metric" in queries.columns:
        parts = [r.metric for r in queries.select("metric").distinct().orderBy("metric").collect()]
        out = None
        for name in parts:
            part = exact(base, queries.where(F.col("metric") == name).drop("metric"), k, name, key, vec, qkey, qvec)
            out = part if out is None else out.union(part)
        if out is not None:
            return out
        queries = queries.drop("metric")
    found = scan(base, entries_of(queries, k, qkey, qvec), kernel or metrics.KERNELS[metric], key=key, vec=vec, kind=kind)
    return top_k(found.withColumnRenamed("pool", "qid"), k, ["qid"], key=key)


def in_group(base: DataFrame, queries: DataFrame, group, qgroup: str, k: int, metric: str = "squared_euclidean") -> DataFrame:
    """(qid, vec_id, dist, rk): each query looks only at rows of its own group."""
    found = scan(base, entries_of(queries, k, group=qgroup), metrics.KERNELS[metric], group=group)
    return top_k(found.withColumnRenamed("pool", "qid"), k, ["qid"])


def group_minima(base: DataFrame, queries: DataFrame, group: str, metric: str = "squared_euclidean", vec: str = "v") -> DataFrame:
    """(group, qid, dist): the distance of every query to the nearest row of each group; a row a group, query and task is shuffled."""
    asked, kernel = entries_of(queries, 1), metrics.KERNELS[metric]

    def run(batches):
        least: dict = {}
        for batch in batches:
            if batch.num_rows:
                x, g = matrix(batch.column(vec)), batch.column("group_").to_numpy()
                names, at = np.unique(g, return_inverse=True)
                order = np.argsort(at, kind="stable")
                starts = np.searchsorted(at[order], np.arange(len(names)))
                for e in asked:
                    low = np.minimum.reduceat(kernel(np.asarray(e.vector), x)[order], starts)
                    for n, d in zip(names.tolist(), low.tolist(), strict=True):
                        least[n, e.pool] = min(d, least.get((n, e.pool), np.inf))
        rows = [(*k, d) for k, d in least.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["group", "qid", "dist"])

    rows = base.where(F.col(vec).isNotNull()).select(F.col(group).cast("long").alias("group_"), vec)
    return rows.mapInArrow(run, "group long, qid long, dist double").groupBy("group", "qid").agg(F.min("dist").alias("dist"))


def centroid_sets(centroids: DataFrame, group: str | None = None) -> dict:
    """{group: (labels, matrix)} of a table (label, cv[, group]) on the driver; labels ascend."""
    rows = [(r[2] if group else 0, r[0], np.array(r[1], float)) for r in centroids.select("label", "cv", *([group] if group else [])).toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    out: dict = {}
    for g, label, v in rows:
        out.setdefault(g, ([], []))
        out[g][0].append(label)
        out[g][1].append(v)
    return {g: (np.array(labels, np.int64), np.array(vs)) for g, (labels, vs) in out.items()}


def nearest(x: np.ndarray, c: np.ndarray, kernel=None) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the centroid nearest to each row, the first on ties: blocks of centroids, a running minimum.
    Without a kernel, products of matrices tell which centroids can be the nearest; only those are compared."""
    if kernel is None and x.size and c.size and (found := _nearest_by_products(x, c)):
        return found
    at, low = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    step = max(1, min(CENTROIDS, (16 << 20) // max(1, x.size)))
    for a in range(0, len(c), step):
        part = c[a : a + step]
        if kernel is None:
            d = ((part[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        else:
            d = np.stack([kernel(row, x) for row in part])
        k = d.argmin(axis=0)
        d = d[k, np.arange(len(x))]
        closer = d < low
        at[closer], low[closer] = a + k[closer], d[closer]
    return at, low


def _nearest_by_products(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """``nearest`` by squared Euclidean distances; none where values are too large or no numbers."""
    at, low = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    with np.errstate(all="ignore"):
        xx, cc = (x * x).sum(axis=1), (c * c).sum(axis=1)
        # each way of summing is off by less than this: a product and a sum lose half an epsilon a value, of at most 2 (xx + cc)
        margin = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + cc.max()) + np.finfo(float).tiny
        if not np.isfinite(margin).all():
            return None
        for a in range(0, len(c), CENTROIDS):
            part = c[a : a + CENTROIDS]
            for b in range(0, len(x), 512):
                rows = x[b : b + 512]
                near = cc[a : a + CENTROIDS] - 2 * (rows @ part.T)
                own, k = np.nonzero(near <= (near.min(axis=1) + margin[b : b + 512])[:, None])
                d = np.concatenate([((part[k[i : i + PAIRS]] - rows[own[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(k), PAIRS)])
                order = np.lexsort((k, d, own))
                first = order[np.append(True, own[order][1:] != own[order][:-1])]
                own, k, d = own[first] + b, k[first], d[first]
                closer = d < low[own]
                at[own[closer]], low[own[closer]] = a + k[closer], d[closer]
    return at, low


def nearest_label(docs: DataFrame, centroids: DataFrame | dict, metric: str = "squared_euclidean", key: str = "vec_id", vec: str = "v", group: str | None = None) -> DataFrame:
    """``docs`` with slot and dist: the centroid nearest to each vector, the lowest label on ties. All columns go
    through, so nothing is joined back. With ``group``, a column of both tables, each row is compared with the
    centroids of its own group; rows of a group without centroids drop. Centroids are a stated table, or what
    ``centroid_sets`` makes of it; rows with a null vector drop."""
    sets = centroids if isinstance(centroids, dict) else centroid_sets(centroids, group)
    kernel = None if metric == "squared_euclidean" else metrics.KERNELS[metric]
    docs = docs.where(F.col(vec).isNotNull())
    docs = docs if group is None else docs.where(F.col(group).isNotNull())
    names = docs.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(names.index(vec)))
            slot, dist, there = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
            g = np.zeros(len(x), np.int64) if group is None else batch.column(names.index(group)).to_numpy()
            for one in np.unique(g).tolist():
                own = np.flatnonzero(g == one)
                if one not in sets:
                    there[own] = False
                    continue
                labels, c = sets[one]
                for a in range(0, len(own), 2048):
                    part = own[a : a + 2048]
                    at, low = nearest(x[part], c, kernel)
                    slot[part], dist[part] = labels[at], low
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot), pa.array(dist)], names=[*names, "slot", "dist"])
            yield out if there.all() else out.filter(pa.array(there))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, slot long, dist double")
