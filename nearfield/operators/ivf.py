"""Inverted-file search: probe centroids, scan the probed slots, keep k.

Postings are a table by slot, saved partitioned by slot: a scan reads the partitions of the probed
slots only. Probes are stated (queries x probes) and go to the tasks with the scan, so that
neither vectors nor queries are joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.operators.knn import centroid_sets, nearest_label
from nearfield.operators.scan import Chosen, Entry, scan
from nearfield.operators.topk import top_k

L2 = metrics.KERNELS["squared_euclidean"]


def probe_count(ratio: float, leaves: int, downgrade: float = 1.0) -> int:
    """Slots to probe: the ratio of the leaves, one at least."""
    return max(1, int(ratio * downgrade * leaves + 1e-9))


def probe_ratio(index_ratio: float, query_ratio: float | None = None, real_time_ratio: float | None = None, real_time: bool = False, ages: bool = False) -> float:
    """The query's ratio before the index's; in real-time segments with age quotas their own ratio, if given."""
    if real_time and ages and real_time_ratio is not None:
        return real_time_ratio
    return index_ratio if query_ratio is None else query_ratio


def postings(docs: DataFrame, centroids: DataFrame, group: str | None = None) -> DataFrame:
    """``docs`` with the slot of their nearest centroid, in one pass."""
    return nearest_label(docs, centroids, group=group).drop("dist")


def save(posting: DataFrame, path: str, spread: int = 1) -> None:
    """Partitioned by slot; each slot is ``spread`` files (rows are dealt by slot and hash)."""
    posting.repartition("slot", F.pmod(F.xxhash64("vec_id"), F.lit(spread))).write.partitionBy("slot").parquet(path)


def nearest_places(d: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest distances, ties by label."""
    return np.lexsort((labels, d))[:n]


def probed(q: np.ndarray, labels: np.ndarray, c: np.ndarray, n: int, kernel=L2) -> list[tuple[int, float]]:
    """(label, distance) of the n centroids nearest to a query, ties by label."""
    d = kernel(q, c)
    near = nearest_places(d, labels, n)
    return list(zip(labels[near].tolist(), d[near].tolist(), strict=True))


def probes(queries: DataFrame, centroids: DataFrame, n: int, kernel=L2) -> DataFrame:
    """(qid, qv, slot, probe_dist, cv), n rows for each query; both tables are stated."""
    spark = queries.sparkSession
    labels, c = centroid_sets(centroids).get(0, (np.zeros(0, np.int64), np.zeros((0, 0))))
    place = {label: i for i, label in enumerate(labels.tolist())}
    rows = [(r[0], [float(x) for x in r[1]]) for r in queries.select("qid", "qv").toLocalIterator()]
    out = [(qid, q, slot, d, c[place[slot]].tolist()) for qid, q in rows for slot, d in probed(np.array(q), labels, c, n, kernel)]
    return spark.createDataFrame(out, "qid long, qv array<double>, slot long, probe_dist double, cv array<double>")


def entries(probe: DataFrame, k: int, offset: bool = False) -> list[Entry]:
    """A scan's entries of probes: the pool is the query, the group the slot."""
    return [Entry(r.qid, list(r.qv), k, r.slot, r.probe_dist if offset else 0.0) for r in probe.toLocalIterator()]


def candidates(probe: DataFrame, posting: DataFrame) -> DataFrame:
    """(qid, vec_id) of all documents of the probed slots, unscored. Probes are stated, so they are sent to the postings."""
    return posting.join(F.broadcast(probe.select("qid", "slot")), "slot")


def search(probe: DataFrame | list[Entry], posting: DataFrame, k: int, kernel=L2) -> DataFrame:
    """(qid, vec_id, dist, rk): the k nearest rows of the probed slots."""
    found = scan(posting, probe if isinstance(probe, list) else entries(probe, k), kernel, group="slot")
    return top_k(found.withColumnRenamed("pool", "qid"), k, ["qid"])


def two_level(docs: DataFrame, rough: DataFrame, fine: DataFrame, beam: int, key: str = "vec_id", vec: str = "v") -> DataFrame:
    """(key, label): the nearest fine centroid among the children of the ``beam`` nearest rough ones, in one pass."""
    import pyarrow as pa

    from nearfield.operators.scan import matrix

    labels, c = centroid_sets(rough)[0]
    children = centroid_sets(fine, "parent")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            near = np.argsort(d, axis=1, kind="stable")[:, :beam]
            low, got = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
            for j, parent in enumerate(labels.tolist()):
                own = np.flatnonzero((near == j).any(axis=1))
                if parent in children and len(own):
                    names, v = children[parent]
                    e = ((x[own][:, None, :] - v[None]) ** 2).sum(axis=2)
                    at = e.argmin(axis=1)
                    e, name = e[np.arange(len(own)), at], names[at]
                    closer = (e < low[own]) | ((e == low[own]) & (name < got[own]))
                    low[own[closer]], got[own[closer]] = e[closer], name[closer]
            there = np.isfinite(low)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(there)), pa.array(got[there])], names=[key, "label"])

    return docs.where(F.col(vec).isNotNull()).select(key, vec).mapInArrow(run, f"{key} long, label long")


def two_stage_entries(queries: DataFrame, rough: DataFrame, fine: DataFrame, n_rough: int, fine_ratio: float, k: int) -> list[Entry]:
    """An entry for each query: all fine centroids of the probed rough slots, of which the nearest share ``fine_ratio``
    stays, 1 at least. A share of the slots is a set of bits for each query."""
    labels, c = centroid_sets(rough)[0]
    children = centroid_sets(fine, "parent")
    slots = np.unique(np.concatenate([names for names, _ in children.values()])) if children else np.zeros(0, np.int64)
    out = []
    for r in queries.select("qid", "qv").where(F.col("qv").isNotNull()).toLocalIterator():
        q = np.array(r.qv, float)
        pool = [children[p] for p, _ in probed(q, labels, c, n_rough) if p in children]
        if pool:
            names = np.concatenate([p[0] for p in pool])
            near = nearest_places(np.concatenate([L2(q, p[1]) for p in pool]), names, probe_count(fine_ratio, len(names)))
            out.append(Entry(r.qid, q, k, Chosen.of(slots, np.searchsorted(slots, names[near]))))
    return out


def group_entries(docs: DataFrame, groups: Column) -> DataFrame:
    """One row for each document and group (level, id)."""
    return docs.withColumn("g", F.explode(groups)).select("*", F.col("g.level").alias("level"), F.col("g.id").alias("id")).drop("g")


def group_key(level, id_) -> Column | int:
    """One number for a group: the level in the upper half."""
    if isinstance(level, int):
        return level << 32 | id_
    return F.shiftleft(level.cast("long"), 32).bitwiseOR(id_.cast("long"))


def group_search(docs: DataFrame, wanted: list[tuple], kernel=L2) -> DataFrame:
    """(qid, pool_id, vec_id, dist, rk): each (qid, qv, level, id, pool_id, k) of ``wanted`` has its own k nearest
    of the rows (vec_id, v, level, id); unknown groups give nothing."""
    asked = [Entry(n, list(q), k, group_key(level, i)) for n, (_, q, level, i, _, k) in enumerate(wanted)]
    found = scan(docs, asked, kernel, group=group_key(F.col("level"), F.col("id")))
    return labelled(docs.sparkSession, found, [(w[0], w[4], w[5]) for w in wanted])


def labelled(spark: SparkSession, found: DataFrame, pools: list[tuple]) -> DataFrame:
    """A scan's rows with (qid, pool_id) for the pool and at most its k. pools: (qid, pool_id, k), a stated list."""
    names = spark.createDataFrame([(n, *p) for n, p in enumerate(pools)], "pool long, qid long, pool_id int, k int")
    most = max((p[2] for p in pools), default=0)
    near = top_k(found, most, ["pool"])
    return near.join(F.broadcast(names), "pool").where("rk <= k").drop("pool", "k")


def global_quota(docs: DataFrame, wanted: list[tuple], total: int, kernel=L2) -> DataFrame:
    """(qid, pool_id, vec_id, dist, rk): one quota over all groups of a query together; a row counts once a group."""
    each = group_search(docs, [(*w[:5], total) for w in wanted], kernel)
    w = Window.partitionBy("qid").orderBy("dist", "vec_id", "pool_id")
    return each.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= total)
