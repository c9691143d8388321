"""Vector aggregates and clustering. Tasks sum their batches in numpy and shuffle one row a key and
task (sums and a count), so no vector is shuffled. Centroids are stated tables on the driver."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.knn import centroid_sets, nearest, nearest_label
from nearfield.operators.scan import matrix

SAMPLE = 10_000  # vectors that starting centroids are drawn from
MEMBERS = 256  # of a cluster that medoids are drawn from


def _sums(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x by group number."""
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(n))
    out = np.zeros((n, x.shape[1]))
    there = np.flatnonzero(np.bincount(of, minlength=n))
    if len(there):
        out[there] = np.add.reduceat(x[order], cuts[there], axis=0)
    return out


def moments(vectors: DataFrame, key: str, vec: str, *functions) -> DataFrame:
    """(key, pos, n, s0, s1, ...): the number of vectors and the sum of each function of their values, by key and position."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            names, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            parts = [_sums(f(x), of, len(names)) for f in functions]
            for i, (name, n) in enumerate(zip(names.tolist(), np.bincount(of).tolist(), strict=True)):
                old = total.get(name, (0, [0.0] * len(parts)))
                total[name] = (old[0] + n, [o + p[i] for o, p in zip(old[1], parts, strict=True)])
        rows = [(name, pos, n, *(float(s[pos]) for s in sums)) for name, (n, sums) in total.items() for pos in range(len(sums[0]))]
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * len(functions)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names_)

    names_ = [key, "pos", "n", *(f"s{i}" for i in range(len(functions)))]
    rows = vectors.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), vec)
    found = rows.mapInArrow(run, f"`{key}` long, pos int, n long" + "".join(f", s{i} double" for i in range(len(functions))))
    return found.groupBy(key, "pos").agg(*(F.sum(c).alias(c) for c in names_[2:]))


def _by_position(vectors, key, vec, value, *functions) -> DataFrame:
    return moments(vectors, key, vec, *functions).select(F.col(key), "pos", value.alias("x"))


def mean(vectors, key, vec="v"):
    return _by_position(vectors, key, vec, F.col("s0") / F.col("n"), lambda x: x)


def harmonic_mean(vectors, key, vec="v"):
    return _by_position(vectors, key, vec, F.col("n") / F.col("s0"), lambda x: 1 / x)


def geometric_mean(vectors, key, vec="v"):
    """By logarithms, so that long products don't overflow; values are positive."""
    return _by_position(vectors, key, vec, F.exp(F.col("s0") / F.col("n")), np.log)


def variance(vectors, key, vec="v"):
    m = F.col("s0") / F.col("n")
    return _by_position(vectors, key, vec, F.col("s1") / F.col("n") - m * m, lambda x: x, lambda x: x * x)


def majority(bits, key, vec="bits"):
    """1 where more than half of the rows, cut down to an integer, have the bit."""
    return _by_position(bits, key, vec, F.when(F.col("s0") > F.floor(F.col("n") / 2), 1).otherwise(0), lambda x: x)


def gathered(rows: DataFrame, key: list[str], name: str = "cv") -> DataFrame:
    """(key, vector) from (key, pos, x)."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(name))


def medoids(vectors: DataFrame, key: str, vec: str = "v", by: str = "vec_id") -> DataFrame:
    """The vector nearest to the mean of each group: a row a group and task is shuffled."""
    centre = {g: np.array(v) for g, v in ((r[0], r[1]) for r in gathered(mean(vectors, key, vec), [key]).toLocalIterator())}

    def run(batches):
        found: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, g = matrix(batch.column(2)), np.asarray(batch.column(1)), batch.column(0).to_numpy()
            d = ((np.array([centre[k] for k in g.tolist()]) - x) ** 2).sum(axis=1)
            for i in np.lexsort((ids, d, g)):
                k, new = int(g[i]), (float(d[i]), int(ids[i]))
                if k not in found or new < found[k]:
                    found[k] = new
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([f[1] for f in found.values()], pa.int64()), pa.array([f[0] for f in found.values()], pa.float64())], names=["group", by, "dist"])

    rows = vectors.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), by, vec).mapInArrow(run, f"group long, {by} long, dist double")
    return rows.groupBy(F.col("group").alias(key)).agg(F.min(F.struct("dist", by)).alias("m")).select(key, F.col(f"m.{by}").alias(by), F.col("m.dist").alias("dist"))


# Clustering: several sets of centroids at once ({set: (labels, matrix)}), for fragments, parents or one set.


def lloyd_sums(vectors: DataFrame, sets: dict, vec: str = "v", group: str | None = None, width: int | None = None) -> dict:
    """{set: (counts, sums, cost)}: one pass over the vectors. The set of a vector is its ``group``; with ``width``
    every vector is cut into fragments of that width, and fragment f belongs to set f. What comes to the driver
    is as large as the centroids."""

    def run(batches):
        total = {g: [np.zeros(len(c)), np.zeros(c.shape), 0.0] for g, (_, c) in sets.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            if width:
                parts = [(f, x[:, f * width : (f + 1) * width]) for f in sets]
            elif group:
                g = batch.column(1).to_numpy()
                parts = [(k, x[g == k]) for k in np.unique(g).tolist() if k in sets]
            else:
                parts = [(0, x)]
            for k, own in parts:
                for a in range(0, len(own), 2048):
                    at, low = nearest(own[a : a + 2048], sets[k][1])
                    t = total[k]
                    t[0] += np.bincount(at, minlength=len(t[0]))
                    t[1] += _sums(own[a : a + 2048], at, len(t[0]))
                    t[2] += float(low.sum())
        rows = [(k, i, n, s.tobytes(), t[2] if i == 0 else 0.0) for k, t in total.items() for i, (n, s) in enumerate(zip(t[0], t[1], strict=True)) if n or i == 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.float64()))], names=["set", "place", "n", "sums", "cost"])

    def add(batches):
        total: dict = {}
        for batch in batches:
            for k, i, n, s, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = total.get((k, i), (0.0, 0.0, 0.0))
                total[k, i] = (old[0] + n, old[1] + np.frombuffer(s), old[2] + cost)
        rows = [(*k, n, s.tobytes(), cost) for k, (n, s, cost) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.float64()))], names=["set", "place", "n", "sums", "cost"])

    kind = "set long, place long, n double, sums binary, cost double"
    rows = vectors.where(F.col(vec).isNotNull()).select(vec, *([F.col(group).cast("long")] if group else [])).mapInArrow(run, kind)
    out = {g: [np.zeros(len(c)), np.zeros(c.shape), 0.0] for g, (_, c) in sets.items()}
    for r in rows.repartition("set", "place").mapInArrow(add, kind).toLocalIterator():
        t = out[r.set]
        t[0][r.place], t[1][r.place] = r.n, np.frombuffer(r.sums)
        t[2] += r.cost
    return out


def lloyd(vectors: DataFrame, sets: dict, rounds: int, epsilon: float = 0.0, digits: int | None = None, **options) -> dict:
    """Lloyd's iteration of all sets at once: at most ``rounds`` rounds, or until the cost moves by less than
    ``epsilon``. An empty cluster keeps its place."""
    before = None
    for _ in range(rounds):
        found = lloyd_sums(vectors, sets, **options)
        new = {}
        for g, (labels, c) in sets.items():
            n, s, _ = found[g]
            means = s / np.maximum(n, 1)[:, None]
            new[g] = (labels, np.where(n[:, None] > 0, np.round(means, digits) if digits is not None else means, c))
        sets, cost = new, sum(t[2] for t in found.values())
        if epsilon and before is not None and abs(before - cost) < epsilon:
            break
        before = cost
    return sets


def table_of(spark, sets: dict, group: str | None = None) -> DataFrame:
    rows = [(*([int(g)] if group else []), int(label), v.tolist()) for g, (labels, c) in sorted(sets.items()) for label, v in zip(labels, c, strict=True)]
    return spark.createDataFrame(rows, (f"{group} long, " if group else "") + "label long, cv array<double>", verifySchema=False)


def kmeans(vectors: DataFrame, centroids: DataFrame, rounds: int = 10, epsilon: float = 1e-6, digits: int | None = None) -> DataFrame:
    """(label, cv) after Lloyd's iteration from given centroids."""
    return table_of(vectors.sparkSession, lloyd(vectors, centroid_sets(centroids), rounds, epsilon, digits))


def codebook(vectors: DataFrame, start: DataFrame, n: int, width: int, rounds: int, digits: int | None = None) -> DataFrame:
    """(frag, code, cv): a clustering for each fragment, all in the same passes, from the start table of the same form."""
    sets = centroid_sets(start.select(F.col("code").alias("label"), "cv", F.col("frag").cast("long").alias("frag")), "frag")
    found = table_of(vectors.sparkSession, lloyd(vectors, {f: sets[f] for f in range(n)}, rounds, 0.0, digits, width=width), "frag")
    return found.select(F.col("frag").cast("int").alias("frag"), F.col("label").cast("int").alias("code"), "cv")


def sample(vectors: DataFrame, most: int = SAMPLE, key: str = "vec_id", vec: str = "v", group: str | None = None) -> DataFrame:
    """The ``most`` vectors (of each group) with the smallest hashes of their ids: a reservoir that doesn't depend on partitions."""
    rows = vectors.where(F.col(vec).isNotNull())
    order = [F.xxhash64(key), F.col(key)]
    if group is None:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("rk_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rk_") <= most).drop("rk_")


def first_centroids(vectors: DataFrame, k: int, key: str = "vec_id", vec: str = "v") -> DataFrame:
    """k vectors by the hash of their id, as starting centroids."""
    rows = sorted((r[0], [float(x) for x in r[1]]) for r in sample(vectors, k, key, vec).select(key, vec).collect())
    return vectors.sparkSession.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "label long, cv array<double>")


def spread(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Places of k starting centres among sampled vectors: the first has the lowest total distance to all, each
    further one is drawn with a chance in proportion to its summed distance to those chosen."""
    dist = lambda i: ((x - x[i]) ** 2).sum(axis=1)
    total = np.array([dist(i).sum() for i in range(len(x))]) if len(x) <= 2000 else ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen, rng = [int(total.argmin())], np.random.default_rng(seed)
    far = dist(chosen[0])
    while len(chosen) < min(k, len(x)):
        free = np.ones(len(x), bool)
        free[chosen] = False
        weight = np.where(free, far, 0.0)
        weight = weight if weight.sum() > 0 else free.astype(float)
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        far = far + dist(chosen[-1])
    return np.array(chosen)


def spread_centroids(vectors: DataFrame, k: int, most: int = SAMPLE, key: str = "vec_id", vec: str = "v") -> DataFrame:
    """k starting centroids, spread out, from a bounded sample of ``most`` vectors."""
    rows = sorted((r[0], [float(x) for x in r[1]]) for r in sample(vectors, most, key, vec).select(key, vec).toLocalIterator())
    x = np.array([v for _, v in rows])
    return vectors.sparkSession.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(spread(x, k))] if rows else [], "label long, cv array<double>")


def medoid_update(vectors: DataFrame, centroids: DataFrame, members: int = MEMBERS, key: str = "vec_id") -> DataFrame:
    """(label, cv): of each cluster the one, among at most ``members`` sampled vectors and their mean, with the least
    total distance to the sample. An empty cluster keeps its centroid."""
    own = sample(nearest_label(vectors.select(key, "v"), centroids), members, key, group="slot")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x = np.stack(rows["v"].to_numpy()).astype(float)
        y = np.vstack([x, x.mean(axis=0)])
        cost = ((y[:, None, :] - x[None]) ** 2).sum(axis=(1, 2))
        return pd.DataFrame({"label": [int(rows["slot"].iloc[0])], "nv": [y[cost.argmin()].tolist()]})

    new = own.select(key, "v", "slot").groupBy("slot").applyInPandas(one, "label long, nv array<double>")
    return centroids.join(new, "label", "left").select("label", F.coalesce("nv", F.transform("cv", lambda x: x.cast("double"))).alias("cv"))


def children(k1: int, k2: int, sizes: dict[int, int]) -> dict[int, int]:
    """How many centroids each cluster gets in the second stage: in proportion to its rows, rounded up."""
    n = sum(sizes.values())
    return {c: math.ceil(k1 * k2 * m / n) for c, m in sizes.items()}


def staged(vectors: DataFrame, ks: list[int], rounds: int = 10, most: int = SAMPLE, key: str = "vec_id") -> list[DataFrame]:
    """Clustering in stages: [(label, cv), (parent, label, cv), ...]. Stage i + 1 divides every cluster of stage i
    into a share of k1 x ... x k(i+1) centroids that goes with its rows; all clusters are fitted in the same passes.
    Starting centroids are spread over a sample of ``most`` vectors in all."""
    spark = vectors.sparkSession
    found = [kmeans(vectors, spread_centroids(vectors, ks[0], most, key), rounds)]
    rows, total = vectors.select(key, "v"), ks[0]
    for k in ks[1:]:
        rows = nearest_label(rows, found[-1], group=None if len(found) == 1 else "parent").select(key, "v", F.col("slot").alias("parent"))
        sizes = {r.parent: r["count"] for r in rows.groupBy("parent").count().toLocalIterator()}
        share = children(total, k, sizes)
        drawn: dict[int, list] = {}
        for r in sample(rows, max(1, most // max(1, len(sizes))), key, group="parent").orderBy("parent", key).toLocalIterator():
            drawn.setdefault(r.parent, []).append([float(x) for x in r.v])
        start, label = {}, 0
        for parent, own in sorted(drawn.items()):
            x = np.array(own)
            at = spread(x, share[parent])
            start[parent] = (np.arange(label, label + len(at)), x[at])
            label += len(at)
        found.append(table_of(spark, lloyd(rows, start, rounds, 1e-6, group="parent"), "parent"))
        total *= k
    return found


def cluster_stats(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    return nearest_label(vectors, centroids).groupBy("slot").agg(F.count("*").alias("n"), F.sum("dist").alias("cost"))


def well_filled(vectors: DataFrame, centroids: DataFrame, ratio: float = 0.5) -> bool:
    """Whether at least ``ratio`` of the clusters hold a vector."""
    return cluster_stats(vectors, centroids).count() >= ratio * centroids.count()


class Trainer(ABC):
    """What makes the centroids and codebooks that an index is built with."""

    @abstractmethod
    def train(self, vectors: DataFrame) -> dict[str, DataFrame]: ...


class CentroidTrainer(Trainer):
    """Centroids in one or more stages and, with ``fragments``, a codebook of raw sub-vectors, from a sample of at
    most ``most`` vectors. ValueError where too few clusters are filled, or the dimension can't be divided."""

    def __init__(self, ks: list[int], fragments: int = 0, codes: int = 16, rounds: int = 10, most: int = 1_000_000, filled: float = 0.5):
        self.ks, self.fragments, self.codes, self.rounds, self.most, self.filled = ks, fragments, codes, rounds, most, filled

    def train(self, vectors: DataFrame) -> dict[str, DataFrame]:
        rows = sample(vectors, self.most)
        out = {f"centroids{i}": c for i, c in enumerate(staged(rows, self.ks, self.rounds))}
        if not well_filled(rows, out["centroids0"], self.filled):
            raise ValueError("too many clusters are empty")
        if self.fragments:
            first = first_centroids(rows, self.codes)
            dim = len(first.first().cv)
            if dim % self.fragments:
                raise ValueError("the dimension isn't a multiple of the number of fragments")
            width = dim // self.fragments
            parts = F.transform(F.sequence(F.lit(0), F.lit(self.fragments - 1)), lambda f: F.struct(f.alias("frag"), F.slice("cv", f * width + 1, width).alias("cv")))
            start = first.select(F.col("label").alias("code"), F.explode(parts).alias("p")).select("p.frag", "code", "p.cv")
            out["codebook"] = codebook(rows, start, self.fragments, width, self.rounds)
        return out
