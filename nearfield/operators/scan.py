"""The scan that every search is made of: rows against stated queries, in numpy blocks.

A wanted entry is a query's vector, the group of rows it looks at (a slot, a category, all, or a
``Chosen`` set of slots) and the pool that its results go into. Entries are stated by the caller; they
go to all tasks in blocks of at most ``BLOCK``, never with a join. Each task keeps the k best rows of every pool, so
only tasks x pools x k rows are shuffled, never vectors. Rows with a null vector are no candidates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.metrics import KERNELS

BLOCK = 16_384
TOGETHER = 256  # entries whose products with a batch are taken at once
LISTED = 4096  # groups that a filter names one by one
EVERY = None


@dataclass(frozen=True, eq=False)
class Chosen:
    """A set of groups as bits: a query that probes many slots is one entry, not one for each slot."""

    labels: np.ndarray  # ascending; one array for all sets over the same groups
    bits: np.ndarray  # packed, the first label's bit highest

    @classmethod
    def of(cls, labels: np.ndarray, places: np.ndarray) -> Chosen:
        there = np.zeros(len(labels), bool)
        there[places] = True
        return cls(labels, np.packbits(there))

    def has(self, places: np.ndarray) -> np.ndarray:
        """Whether the labels at ``places`` are chosen."""
        return (self.bits[places >> 3] >> (7 - (places & 7)) & 1).astype(bool)


@dataclass(frozen=True)
class Entry:
    pool: int
    vector: tuple | list
    k: int
    group: int | Chosen | None = EVERY
    offset: float = 0.0  # added to every distance
    context: object = None  # for ``prepare``


def matrix(column: pa.Array, kind=float) -> np.ndarray:
    """A list column as (rows, dimension); every row has one dimension."""
    flat = np.asarray(column.flatten()).astype(kind, copy=False)
    d = len(flat) // max(1, len(column))
    if d * len(column) != len(flat) or column.null_count or len(set(np.diff(column.offsets).tolist())) > 1:
        raise ValueError("vectors of different dimensions")
    return flat.reshape(len(column), d)


def best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, ties by id."""
    if len(dist) > k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])  # all that tie with the k-th stay until ids have decided
        return near[np.lexsort((ids[near], dist[near]))[:k]]
    return np.arange(len(dist))


def scan(rows: DataFrame, entries: list[Entry], kernel, prepare=None, key: str = "vec_id", vec: str = "v", group: Column | str | None = None, kind=float, distinct: bool = False, check: bool = True, also: tuple | None = None) -> DataFrame:
    """(pool, key, dist) with each pool's k nearest rows of each task: a superset of the k nearest of all.

    ``kernel(q, x)`` gives the distances of a prepared query and a matrix of rows, or a pair (distances, ranks):
    then there is a column rank. ``prepare(entry)`` makes what the kernel gets in place of the vector; with an
    attribute ``by_group`` it is asked for each group of a ``Chosen`` set.
    ``distinct``: a row that a pool meets in several groups counts once.
    ``also``: (column, kernel) of a second vector of the rows; there is a column also with that kernel's distance
    between an entry's vector and it, taken of the rows that are kept only. Rows without it are no candidates.
    """
    paired = bool(getattr(kernel, "paired", False))
    added = [*(["rank"] if paired else []), *(["also"] if also else [])]
    names = ["pool", key, "dist", *added]
    kinds = f"pool long, {key} long, dist double" + "".join(f", {c} double" for c in added)
    rows = rows.where(F.col(vec).isNotNull())
    if also:
        rows = rows.where(F.col(also[0]).isNotNull())
    grouped = group is not None
    picked = rows.select(F.col(key).cast("long").alias(key), vec, *([F.col(also[0]).alias("also_")] if also else []), *([(F.col(group) if isinstance(group, str) else group).cast("long").alias("group_")] if grouped else []))
    if grouped:
        wanted = _listed(entries)
        if wanted is not None:
            picked = picked.where(F.col("group_").isin(wanted))  # prunes the partitions of a saved index
    out = None
    for a in range(0, max(1, len(entries)), BLOCK):
        part = picked.mapInArrow(_scanner(entries[a : a + BLOCK], kernel, prepare, key, vec, grouped, kind, distinct, names, paired, check, also and also[1], prepare is None and kind is float and kernel is KERNELS["squared_euclidean"]), kinds)
        out = part if out is None else out.union(part)
    return out


def _listed(entries: list[Entry]) -> list[int] | None:
    """The groups that entries look at, if there are few."""
    single, many = set(), {}
    for e in entries:
        if e.group is EVERY:
            return None
        if isinstance(e.group, Chosen):
            labels, bits = many.get(id(e.group.labels), (e.group.labels, 0))
            many[id(e.group.labels)] = (labels, bits | e.group.bits)
        else:
            single.add(e.group)
    for labels, bits in many.values():
        single.update(labels[np.unpackbits(bits, count=len(labels)).astype(bool)].tolist())
    return sorted(single) if len(single) <= LISTED else None


def _scanner(entries, kernel, prepare, key, vec, grouped, kind, distinct, names, paired, check, second, euclidean):
    def run(batches):
        by_slot = getattr(prepare, "by_group", False)
        ready = [None if by_slot and isinstance(e.group, Chosen) else prepare(e) if prepare else np.asarray(e.vector, kind) for e in entries]
        by_group: dict = {}
        sets: dict = {}
        for i, e in enumerate(entries):
            if isinstance(e.group, Chosen):
                sets.setdefault(id(e.group.labels), (e.group.labels, []))[1].append(i)
            else:
                by_group.setdefault(e.group, []).append(i)
        kept: dict[int, list] = {}

        def offer(i: int, x: np.ndarray, own: np.ndarray, z: np.ndarray | None = None, once: bool = False, q=None) -> None:
            """``z``: the rows' second vectors, if there are any. ``once``: no key is there twice."""
            e, q = entries[i], ready[i] if q is None else q
            if check and prepare is None and x.shape[1] != len(q):
                raise ValueError(f"queries have {len(q)} dimensions, vectors {x.shape[1]}")
            if check and z is not None and z.shape[1] != len(e.vector):
                raise ValueError(f"queries have {len(e.vector)} dimensions, vectors {z.shape[1]}")
            found = kernel(q, x)
            d, more = found if paired else (found, None)
            near = best(d, own, e.k) if once or not distinct else np.arange(len(d))
            old = kept.get(e.pool)
            if z is not None and old is not None and len(old[0]) == e.k > 0:
                near = near[d[near] + e.offset <= old[0].max()]  # others aren't kept
            new = [d[near] + e.offset, own[near], *([more[near]] if paired else []), *([second(np.asarray(e.vector, float), z[near])] if z is not None else [])]
            both = new if old is None else [np.append(x, y) for x, y in zip(old, new, strict=True)]
            if distinct:
                order = np.lexsort((both[0], both[1]))
                first = order[np.append(True, both[1][order][1:] != both[1][order][:-1])] if len(order) else order
                both = [b[first] for b in both]
            at = best(both[0], both[1], e.k)
            kept[e.pool] = [b[at] for b in both]

        def products(members: list[int], y: np.ndarray):
            """A function of (entry, places of rows) that leaves the places that can be among its k best: products of matrices
            bound the squared distances, of which the kernel takes those that are left. None where they don't bound."""
            if any(len(ready[i]) != y.shape[1] for i in members):
                return None
            q, yy = np.stack([ready[i] for i in members]), (y * y).sum(axis=1)
            qq = (q * q).sum(axis=1)
            # each way of summing is off by less than this
            margin = 16 * (y.shape[1] + 4) * np.finfo(float).eps * (qq + yy.max()) + np.finfo(float).tiny  # of a distance near 0 too
            if not np.isfinite(margin).all():
                return None
            at, block = {i: j for j, i in enumerate(members)}, [-1, None]

            def close(i: int, near: np.ndarray) -> np.ndarray:
                j, e, old = at[i], entries[i], kept.get(entries[i].pool)
                if block[0] != j // TOGETHER:
                    a = j // TOGETHER * TOGETHER
                    block[:] = [j // TOGETHER, yy - 2 * (q[a : a + TOGETHER] @ y.T)]
                d = block[1][j % TOGETHER][near] + qq[j]
                most = np.partition(d, e.k - 1)[e.k - 1] + margin[j] if len(d) > e.k > 0 else np.inf
                if old is not None and len(old[0]) == e.k > 0:
                    most = min(most, old[0].max() - e.offset)
                return near if most == np.inf else near[d <= most + margin[j]]

            return close

        def offer_sets(x: np.ndarray, own: np.ndarray, z: np.ndarray | None, g: np.ndarray) -> None:
            names, at = np.unique(g, return_inverse=True)
            for labels, members in sets.values():
                places = np.minimum(np.searchsorted(labels, names), max(0, len(labels) - 1))
                known = labels[places] == names if len(labels) else np.zeros(len(names), bool)
                rows = np.flatnonzero(known[at])
                if not len(rows):
                    continue
                y, keys, of = (x, own, at) if len(rows) == len(x) else (x[rows], own[rows], at[rows])
                w = z if z is None or len(rows) == len(x) else z[rows]
                once = distinct and len(np.unique(keys)) == len(keys)
                close = products(members, y) if euclidean and (once or not distinct) else None
                for i in members:
                    chosen = entries[i].group.has(places) & known
                    near = np.flatnonzero(chosen[of])
                    if close is not None:
                        near = close(i, near)
                    if by_slot:
                        for n in np.flatnonzero(chosen).tolist():
                            part = near[of[near] == n]
                            offer(i, y[part], keys[part], w if w is None else w[part], once, prepare(replace(entries[i], group=int(names[n]))))
                    elif len(near) == len(y):
                        offer(i, y, keys, w, once)
                    elif len(near):
                        offer(i, y[near], keys[near], w if w is None else w[near], once)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch.column(vec), kind), np.asarray(batch.column(key))
            z = matrix(batch.column("also_")) if second else None
            for i in by_group.get(EVERY, ()):
                offer(i, x, own, z)
            if grouped:
                g = batch.column("group_").to_numpy(zero_copy_only=False)
                order = np.argsort(g, kind="stable")
                cuts = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)], strict=True):
                    if members := by_group.get(int(g[order[a]])):
                        near = order[a:b]
                        for i in members:
                            offer(i, x[near], own[near], z if z is None else z[near])
                if sets:
                    offer_sets(x, own, z, g)
        pools = list(kept)
        columns = [np.repeat(np.array(pools, np.int64), [len(kept[p][0]) for p in pools]), *(np.concatenate([np.zeros(0, t), *(kept[p][c] for p in pools)]) for c, t in ((1, np.int64), (0, float), *((c, float) for c in range(2, len(names) - 1))))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def entries_of(queries: DataFrame, k: int, key: str = "qid", vec: str = "qv", group: str | None = None) -> list[Entry]:
    """The entries of a stated table of queries; every query is a pool."""
    columns = [key, vec, *([group] if group else [])]
    return [Entry(r[0], [float(x) for x in r[1]], k, r[2] if group else EVERY) for r in queries.select(columns).where(F.col(vec).isNotNull()).toLocalIterator()]
