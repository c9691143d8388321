"""Product quantisation: codes, look-up tables, distances from codes, refinement.

Codebooks are stated tables of fragments x codes; they go to the tasks as arrays. Codes come
from one pass without a shuffle, and distances from codes from a scan with a local top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import encode
from nearfield.operators.scan import Entry, matrix, scan
from nearfield.operators.topk import top_k


def book(codebook: DataFrame, n: int) -> np.ndarray:
    """[fragment, code, position] of a table (frag, code, cv) of whole fragments; codes count from 0."""
    rows = sorted((r.frag, r.code, [float(x) for x in r.cv]) for r in codebook.select("frag", "code", "cv").toLocalIterator())
    per = len(rows) // n
    if per * n != len(rows) or [r[:2] for r in rows] != [(f, c) for f in range(n) for c in range(per)]:
        raise ValueError("a codebook has the same codes, counted from 0, in every fragment")
    return np.array([r[2] for r in rows]).reshape(n, per, -1)


def encoded(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Codes [row, fragment]: the nearest code of each fragment, the lowest on ties."""
    n, _, width = centres.shape
    out = np.empty((len(x), n), np.int32)
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024].reshape(-1, n, width)
        for f in range(n):
            out[a : a + 1024, f] = ((part[:, f, None, :] - centres[f][None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def codes(vectors: DataFrame, centres: np.ndarray, vec: str = "v", centroids: dict | None = None, slot: str = "slot") -> DataFrame:
    """``vectors`` with codes in place of ``vec``; of residuals to the row's centroid where ``centroids``
    ({slot: vector}) is given. Rows with a null vector drop."""
    vectors = vectors.where(F.col(vec).isNotNull())
    names = vectors.columns
    kept = [c for c in names if c != vec]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(names.index(vec)))
            if centroids is not None:
                x = x - np.array([centroids[s] for s in batch.column(names.index(slot)).to_pylist()])
            got = encoded(x, centres)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), lists], names=[*kept, "codes"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.schema.fields if f.name != vec)
    return vectors.mapInArrow(run, fields + "codes array<int>")


def table(q, centres: np.ndarray) -> np.ndarray:
    """The look-up table [fragment, code] of a query."""
    n, _, width = centres.shape
    return ((np.asarray(q, float).reshape(n, 1, width) - centres) ** 2).sum(axis=2)


def dots(q, centres: np.ndarray) -> np.ndarray:
    n, _, width = centres.shape
    return (np.asarray(q, float).reshape(n, 1, width) * centres).sum(axis=2)


def gathered(lut: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the table's entries at each row's codes."""
    return lut[np.arange(lut.shape[0]), rows].sum(axis=1)


def bytes_table(lut: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(table in bytes, a, b): q = floor((d - least of the fragment) * a), distance = sum(q) / a + b."""
    lo, hi = lut.min(axis=1), lut.max(axis=1)
    span = hi - lo
    a = min(255.0 / span.max(), 65535.0 / span.sum()) if span.max() > 0 else 1.0
    return np.floor((lut - lo[:, None]) * a).astype(np.int64), float(a), float(lo.sum())


def adc(coded: DataFrame, entries: list[Entry], centres: np.ndarray, mode: str = "plain", centroids: dict | None = None, group: str | None = None, digits: int = 9, key: str = "vec_id", distinct: bool = False, also: tuple | None = None) -> DataFrame:
    """(pool, key, dist) from codes. ``mode``: plain look-up tables; residual (the entry's group is a slot; the
    table is of the query less the slot's centroid); terms (the same distance as |q - C|^2, in ``offset``, and
    |y|^2 + 2 C.y - 2 q.y, of which the middle terms depend on the slot alone); fast (tables in bytes). ``also``: as in ``scan``, such as the exact distances of the rows that are kept."""

    def built(slot):
        c = np.asarray(centroids[slot], float).reshape(centres.shape[0], 1, centres.shape[2])
        return ((centres + 2 * c) * centres).sum(axis=2)

    def prepare(e: Entry):
        if mode == "residual":
            return table(np.asarray(e.vector) - np.asarray(centroids[e.group]), centres)
        if mode == "terms":
            return built(e.group) - 2 * dots(e.vector, centres)
        lut = table(e.vector, centres)
        return bytes_table(lut) if mode == "fast" else lut

    prepare.by_group = mode in ("residual", "terms")

    def kernel(lut, rows):
        if mode == "fast":
            q, a, b = lut
            return np.round(gathered(q, rows) / a + b, digits)
        return np.round(gathered(lut, rows), digits)

    return scan(coded, entries, kernel, prepare, key=key, vec="codes", group=group, kind=np.int64, distinct=distinct, also=also)


def lookup(queries: DataFrame, centres: np.ndarray, fast: bool = False) -> DataFrame:
    """(qid, frag, code, d[, a, b]): the look-up tables of stated queries as rows."""
    out = []
    for r in queries.select("qid", "qv").toLocalIterator():
        lut = table([float(x) for x in r.qv], centres)
        q, a, b = bytes_table(lut) if fast else (lut, None, None)
        out += [(r.qid, f, c, q[f, c].item(), *((a, b) if fast else ())) for f in range(lut.shape[0]) for c in range(lut.shape[1])]
    return queries.sparkSession.createDataFrame(out, "qid long, frag int, code int, d " + ("long, a double, b double" if fast else "double"))


def residuals(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """(…, slot, v): vectors less the centroid of their slot; centroids are a stated table, sent as arrays."""
    return docs.join(F.broadcast(centroids.select(F.col("label").alias("slot"), "cv")), "slot").withColumn("v", encode.residual(F.col("v"), F.col("cv"))).drop("cv")


def refine(coarse: DataFrame, features: DataFrame, entries: list[Entry], k: int, kernel, key: str = "vec_id") -> DataFrame:
    """Exact distances for the candidates (pool, key), k nearest of each pool. There are no more candidates than
    entries x their k, so they are sent to the features; only vectors of candidates are compared."""
    met = features.select(key, "v").join(F.broadcast(coarse.select("pool", key).distinct()), key)
    asked = {e.pool: Entry(e.pool, e.vector, k, e.pool) for e in entries}
    found = scan(met, list(asked.values()), kernel, key=key, group="pool")
    return top_k(found, k, ["pool"], key=key)
