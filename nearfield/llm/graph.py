"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.storage import shared_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes: a
    logarithmic number of rounds in practice, each one aggregation (combined before the
    shuffle, so a hub is no hot group) and one join that adaptive execution may split.
    Null ends and self links are ignored; an empty table gives an empty table.
    """
    shared_dir(links.sparkSession)
    a, b = F.col(a), F.col(b)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    star = edges.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("node"), "component").union(star.select(F.col("component").alias("node"), "component").distinct())
