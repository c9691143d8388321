"""Merging of indexes, recall, and splitting by category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_docid(indexes: list[DataFrame], id_map: DataFrame) -> DataFrame:
    """Rows of all indexes under their new ids. id_map: (part, doc_id, new_id); a row without entry, or with -1, is deleted."""
    rows = reduce(DataFrame.unionByName, (x.withColumn("part", F.lit(i)) for i, x in enumerate(indexes)))
    kept = id_map.where("new_id >= 0")
    return rows.join(kept, ["part", "doc_id"]).drop("part", "doc_id").withColumnRenamed("new_id", "doc_id")


def by_key(indexes: list[DataFrame], keys: DataFrame) -> DataFrame:
    """Rows of all indexes whose pk has a new id; of a pk in several indexes, the last index's row."""
    rows = reduce(DataFrame.unionByName, (x.withColumn("part", F.lit(i)) for i, x in enumerate(indexes)))
    last = rows.groupBy("pk").agg(F.max("part").alias("part"))
    return rows.join(last, ["pk", "part"]).join(keys, "pk").drop("part", "doc_id").withColumnRenamed("new_id", "doc_id")


def requantised(indexes: list[DataFrame]) -> tuple[DataFrame, float, float]:
    """(rows of all indexes with 8-bit codes of the range of all, its least, its largest value): codes of parts can't be
    kept when ranges differ. Rows have v."""
    from nearfield.functions import encode

    rows = reduce(DataFrame.unionByName, indexes)
    lo, hi = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    return rows.withColumn("codes", encode.sq8_encode(F.col("v"), F.lit(lo), F.lit(hi))), lo, hi


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first in ``order``."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r")).select(key, "r.*")


def recall_with_ties(found: DataFrame, truth: DataFrame, k: int, by: str = "qid", key: str = "vec_id") -> DataFrame:
    """(by, recall) at k, where all that tie with the k-th true neighbour count as true ones. truth: (by, key, dist, rk), longer than k."""
    last = truth.where(F.col("rk") == k).select(by, F.col("dist").alias("last"))
    true = truth.join(last, by).where(F.col("dist") <= F.col("last")).select(by, key)
    hit = found.where(F.col("rk") <= k).join(true.withColumn("hit", F.lit(1)), [by, key], "left")
    return hit.groupBy(by).agg((F.least(F.count("hit"), F.lit(k)) / k).alias("recall"))


def recall_by_score(found: DataFrame, truth: DataFrame, by: str = "qid", tolerance: float = 1e-6) -> DataFrame:
    """(by, recall): the share of true ranks matched, in order, by a found score no further than ``tolerance`` from theirs.
    Where found scores can't be below the true ones, that is the rank's own place among the scores."""
    w = Window.partitionBy(by, "bin").orderBy("dist", "rk")
    binned = lambda df: df.withColumn("bin", F.round(F.col("dist") / tolerance / 2)).withColumn("place", F.row_number().over(w)).select(by, "bin", "place")
    hit = binned(truth).join(binned(found).withColumn("hit", F.lit(1)), [by, "bin", "place"], "left")
    return hit.groupBy(by).agg((F.count("hit") / F.count("*")).alias("recall"))


def recall(found: DataFrame, truth: DataFrame, by: str = "qid", key: str = "vec_id") -> DataFrame:
    """(by, recall): the share of the true neighbours that were found."""
    hit = truth.join(found.select(by, key).distinct().withColumn("hit", F.lit(1)), [by, key], "left")
    return hit.groupBy(by).agg((F.count("hit") / F.count("*")).alias("recall"))


def by_category_size(docs: DataFrame, category: str, threshold: int, key: str | None = None) -> DataFrame:
    """``docs`` with ``kind``: 'ivf' in categories of more than ``threshold`` rows, else 'flat'.
    A ``key`` that repeats is an error."""
    if key and docs.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    n = docs.groupBy(category).agg(F.count("*").alias("n"))
    return docs.join(n, category).withColumn("kind", F.when(F.col("n") > threshold, "ivf").otherwise("flat")).drop("n")
