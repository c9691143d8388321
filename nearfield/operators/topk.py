"""Top-k with quotas, deletions, ages and merging of groups. Ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int | Column, by: list[str], dist: str = "dist", key: str = "vec_id", most: int | None = None) -> DataFrame:
    """The k smallest distances of each ``by``. A k that differs by row needs a literal bound
    ``most``, so that Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(dist, key)
    ranked = scored.withColumn("rk", F.row_number().over(w))
    if isinstance(k, int):
        return ranked.where(F.col("rk") <= k)
    return ranked.where((F.col("rk") <= k) & (F.col("rk") <= most))


def delete_before(scored: DataFrame, deleted: DataFrame, k: int, by: list[str], key: str = "vec_id") -> DataFrame:
    """Deleted rows don't count: k live rows where there are so many."""
    return top_k(scored.join(deleted, key, "left_anti"), k, by, key=key)


def delete_after(scored: DataFrame, deleted: DataFrame, k: int, by: list[str], key: str = "vec_id") -> DataFrame:
    """Deleted rows hold their place and go at the end: k rows or fewer."""
    return top_k(scored, k, by, key=key).join(deleted, key, "left_anti")


def age_bucket(age: Column, ages: list[int]) -> Column:
    """Ordinal of the first age limit that holds ``age``; null beyond the last or for a future time. 3600 counts as 5400."""
    out = None
    for i, limit in enumerate(sorted(5400 if a == 3600 else a for a in ages)):
        hit = age.between(0, limit)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def age_entries(queries: list[tuple], quotas: list[tuple[int, int]]) -> tuple[list, list[tuple]]:
    """(entries, pools) of a scan grouped by age bucket: each bucket of each query (qid, vector) is a pool with its own k."""
    from nearfield.operators.scan import Entry

    quotas = sorted((5400 if a == 3600 else a, k) for a, k in quotas)
    pools = [(qid, i, k) for qid, _ in queries for i, (_, k) in enumerate(quotas)]
    vectors = dict(queries)
    return [Entry(n, vectors[qid], k, i) for n, (qid, i, k) in enumerate(pools)], pools


def full_sort_live(ranked: DataFrame, deleted: DataFrame, k: int, by: list[str], dist: str = "dist", key: str = "vec_id") -> DataFrame:
    """Real-time buckets of up to 7200 s: the whole sorted list is walked until there are k live rows (deleted
    rows don't count), however many deleted ones stand before them. Where ages go beyond, ``delete_after`` holds."""
    return top_k(ranked.join(deleted, key, "left_anti"), k, by, dist, key)


def quota_or_total(k: int, total: int) -> int:
    """A group's quota; 0 stands for the query's total."""
    return k or total


def dedupe_scores(found: DataFrame, by: list[str], key: str = "vec_id", tolerance: float = 1e-6) -> DataFrame:
    """Rows of one key are one where their scores differ by no more than ``tolerance`` from the one before (in order
    of score); others stay, as in graph searches."""
    w = Window.partitionBy(*by, key).orderBy("dist", "pool_id")
    step = F.col("dist") - F.lag("dist").over(w)
    return found.withColumn("step_", step).where(F.col("step_").isNull() | (F.col("step_") > tolerance)).drop("step_")


def dedupe(found: DataFrame, by: list[str], key: str = "vec_id") -> DataFrame:
    """Each row once, with its smallest distance and that one's pool."""
    return found.groupBy(*by, key).agg(F.min(F.struct("dist", "pool_id")).alias("m")).select(*by, key, F.col("m.dist").alias("dist"), F.col("m.pool_id").alias("pool_id"))


def fill_left(found: DataFrame, scored: DataFrame, total: int, by: list[str], key: str = "vec_id") -> DataFrame:
    """``found`` and, up to ``total`` in all, the nearest of the rest."""
    rest = scored.join(found.select(*by, key), [*by, key], "left_anti")
    n = found.groupBy(*by).agg(F.count("*").alias("n"))
    more = top_k(rest.join(n, by, "left"), F.lit(total) - F.coalesce("n", F.lit(0)), by, key=key, most=total)
    return found.select(*by, key, "dist").union(more.select(*by, key, "dist"))


def visit_limit(postings: DataFrame, by: list[str], slot: str, count: str, limit: int) -> DataFrame:
    """Postings in slot order, stopping before the one with which the visits would reach the limit."""
    w = Window.partitionBy(*by).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    return postings.withColumn("visited", F.sum(count).over(w)).where(F.col("visited") < limit)
