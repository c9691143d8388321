"""Real-time segments by Structured Streaming: appended vectors, tombstones, and search over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(stream: DataFrame, path: str, checkpoint: str, key: str = "pk", time: str = "ts", delay: str = "1 hour"):
    """Start a query that appends new keys to the Parquet folder ``path``; a key that comes again within ``delay`` is rejected."""
    fresh = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tombstones(stream: DataFrame, path: str, checkpoint: str, key: str = "pk"):
    return stream.select(key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(segments: DataFrame, deleted: DataFrame, key: str = "pk") -> DataFrame:
    return segments.join(deleted.select(key).distinct(), key, "left_anti")


def union_search(full: DataFrame, recent: DataFrame, probe: DataFrame, k: int, kernel) -> DataFrame:
    """One table of probes serves the full index and the recent segment; the k nearest of both."""
    from nearfield.operators.ivf import search

    return search(probe, full.unionByName(recent), k, kernel)


def updated(segments: DataFrame, changes: DataFrame, key: str = "pk") -> DataFrame:
    """Rows of ``segments`` with those of ``changes`` in place of theirs: a deletion and an addition."""
    return live(segments, changes, key).unionByName(changes)


def compact(segments: DataFrame, deleted: DataFrame, path: str, key: str = "pk", by: str | None = None) -> DataFrame:
    """Rewrite segments without deleted keys as one table, partitioned by ``by``; a key that is in several segments
    keeps one row, that of the smallest other columns."""
    rows = live(segments, deleted, key)
    rows = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("row_")).select(key, "row_.*")
    writer = rows.repartition(by).write.partitionBy(by) if by else rows.write
    writer.parquet(path)
    return segments.sparkSession.read.parquet(path)


def answered(requests: DataFrame, search, path: str, checkpoint: str):
    """A stream of queries answered in micro-batches: ``search`` gets each batch of queries and its rows are appended to ``path`` by batch, once."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def global_id(segment, doc):
    """segment << 32 | doc"""
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(doc.cast("long"))
