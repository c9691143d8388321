"""Distances, smaller is closer: as Column expressions and as numpy kernels.

An expression takes two array columns; a kernel takes a query (d,) and vectors (m, d) and
returns (m,). Both sum in double and agree to rounding. Where a denominator is zero the distance
is 0. Kernels take int8 and int16 vectors too, widened to double.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _pairs(q: Column, v: Column, f) -> Column:
    return F.zip_with(q, v, lambda x, y: f(x.cast("double"), y.cast("double")))


def _mean(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double"))) / F.size(v)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def squared_euclidean(q, v):
    return _sum(_pairs(q, v, lambda x, y: (x - y) * (x - y)))


def euclidean(q, v):
    return F.sqrt(squared_euclidean(q, v))


def manhattan(q, v):
    return _sum(_pairs(q, v, lambda x, y: F.abs(x - y)))


def chebyshev(q, v):
    return F.array_max(_pairs(q, v, lambda x, y: F.abs(x - y)))


def inner_product(q, v):
    return -_sum(_pairs(q, v, lambda x, y: x * y))


def cosine(q, v):
    dot = _sum(_pairs(q, v, lambda x, y: x * y))
    norms = F.sqrt(_sum(_pairs(q, q, lambda x, y: x * y))) * F.sqrt(_sum(_pairs(v, v, lambda x, y: x * y)))
    return F.when(norms == 0, 0.0).otherwise(1 - F.try_divide(dot, norms))


def canberra(q, v):
    return _sum(_pairs(q, v, lambda x, y: _ratio(F.abs(x - y), F.abs(x) + F.abs(y))))


def bray_curtis(q, v):
    return _ratio(manhattan(q, v), _sum(_pairs(q, v, lambda x, y: F.abs(x + y))))


def _centred(q, v, f):
    mq, mv = _mean(q), _mean(v)
    return _sum(F.zip_with(q, v, lambda x, y: f(x.cast("double") - mq, y.cast("double") - mv)))


def correlation(q, v):
    norms = F.sqrt(_centred(q, v, lambda x, y: x * x)) * F.sqrt(_centred(q, v, lambda x, y: y * y))
    return F.when(norms == 0, 0.0).otherwise(1 - F.try_divide(_centred(q, v, lambda x, y: x * y), norms))


def normalized_squared_euclidean(q, v):
    return _ratio(_centred(q, v, lambda x, y: (x - y) * (x - y)), _centred(q, v, lambda x, y: x * x) + _centred(q, v, lambda x, y: y * y)) / 2


def normalized_euclidean(q, v):
    return F.sqrt(normalized_squared_euclidean(q, v))


def equality(q, v):
    return F.when(F.forall(_pairs(q, v, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), lambda x: x == 1.0), 0.0).otherwise(1.0)


def weighted_squared_euclidean(q, v, w):
    return _sum(F.transform(F.arrays_zip(q.alias("q"), v.alias("v"), w.alias("w")), lambda p: p["w"].cast("double") * (p["q"].cast("double") - p["v"].cast("double")) * (p["q"].cast("double") - p["v"].cast("double"))))


FLOAT = {
    "squared_euclidean": squared_euclidean,
    "euclidean": euclidean,
    "normalized_squared_euclidean": normalized_squared_euclidean,
    "normalized_euclidean": normalized_euclidean,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "chessboard": chebyshev,
    "cosine": cosine,
    "canberra": canberra,
    "bray_curtis": bray_curtis,
    "correlation": correlation,
    "equality": equality,
    "inner_product": inner_product,
}


def _seq(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return x.sum(axis=-1)


def _div(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, 0.0, a / b)


def _k_cosine(q, v):
    norms = np.sqrt(_seq(q * q)) * np.sqrt(_seq(v * v))
    return np.where(norms == 0, 0.0, 1 - _div(_seq(q * v), norms))


def _k_centre(x):
    return x - (_seq(x) / x.shape[-1])[..., None]


def _k_nsq(q, v):
    a, b = _k_centre(q), _k_centre(v)
    return _div(_seq((a - b) ** 2), _seq(np.broadcast_to(a * a, b.shape)) + _seq(b * b)) / 2


KERNELS = {
    "squared_euclidean": lambda q, v: _seq((q - v) * (q - v)),
    "euclidean": lambda q, v: np.sqrt(_seq((q - v) * (q - v))),
    "normalized_squared_euclidean": _k_nsq,
    "normalized_euclidean": lambda q, v: np.sqrt(_k_nsq(q, v)),
    "manhattan": lambda q, v: _seq(np.abs(q - v)),
    "chebyshev": lambda q, v: np.abs(q - v).max(axis=-1),
    "chessboard": lambda q, v: np.abs(q - v).max(axis=-1),
    "cosine": _k_cosine,
    "canberra": lambda q, v: _seq(_div(np.abs(q - v), np.abs(q) + np.abs(v))),
    "bray_curtis": lambda q, v: _div(_seq(np.abs(q - v)), _seq(np.abs(q + v))),
    "correlation": lambda q, v: _k_cosine(_k_centre(q), _k_centre(v)),
    "equality": lambda q, v: (q != v).any(axis=-1).astype(float),
    "inner_product": lambda q, v: -_seq(q * v),
}


def weighted(w, root: bool = False):
    """The squared Euclidean distance with a weight a dimension, or its root."""
    w = np.asarray(w, float)

    def kernel(q, v):
        d = _seq(w * (q - v) * (q - v))
        return np.sqrt(d) if root else d

    return kernel


def normaliser(metric: str):
    """Distances back to similarities: the inner product itself, 1 less the cosine and correlation distances."""
    if metric.endswith("inner_product"):
        return lambda d: -d
    return (lambda d: 1 - d) if metric in ("cosine", "correlation") else (lambda d: d)


def half(metric: str):
    """A kernel on values rounded to half precision."""
    k = KERNELS[metric]
    return lambda q, v: k(q.astype(np.float16).astype(float), v.astype(np.float16).astype(float))


KERNELS |= {f"half_{m}": half(m) for m in ("squared_euclidean", "inner_product")}


# Bit vectors: arrays of 64-bit words.


def pack_bits(bits: Column, word: int = 32) -> Column:
    """An array of 0 and 1 as words, the first bit highest. Words of 32 bits keep clear of the sign."""
    starts = F.sequence(F.lit(1), F.size(bits), F.lit(word))
    return F.transform(starts, lambda i: F.aggregate(F.slice(bits, i, word), F.lit(0).cast("long"), lambda s, x: s * 2 + x.cast("long")))


def _count(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x).cast("double")


def _cells(a, b, n):
    both = _count(a, b, lambda x, y: x.bitwiseAND(y))
    either = _count(a, b, lambda x, y: x.bitwiseOR(y))
    left = _count(a, a, lambda x, y: x)
    differ = either - both
    return both, left - both, differ - (left - both), n - either, differ


BINARY = {
    "hamming": lambda a, b, n: _cells(a, b, n)[4],
    "jaccard": lambda a, b, n: _ratio(_cells(a, b, n)[4], _cells(a, b, n)[0] + _cells(a, b, n)[4]),
    "matching": lambda a, b, n: _cells(a, b, n)[4] / n,
    "dice": lambda a, b, n: _ratio(_cells(a, b, n)[4], _cells(a, b, n)[0] * 2 + _cells(a, b, n)[4]),
    "rogers_tanimoto": lambda a, b, n: _cells(a, b, n)[4] * 2 / (_cells(a, b, n)[4] + n),
    "russell_rao": lambda a, b, n: (n - _cells(a, b, n)[0]) / n,
    "sokal_michener": lambda a, b, n: _cells(a, b, n)[4] / n,
    "sokal_sneath": lambda a, b, n: _ratio(_cells(a, b, n)[4] * 2, _cells(a, b, n)[0] + _cells(a, b, n)[4] * 2),
    "yule": lambda a, b, n: _ratio(_cells(a, b, n)[1] * _cells(a, b, n)[2] * 2, _cells(a, b, n)[0] * _cells(a, b, n)[3] + _cells(a, b, n)[1] * _cells(a, b, n)[2]),
}


# Composite metrics over parts of vectors.


def _parts(v: Column, p: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(p)), lambda i: F.slice(v, i, p))


def permutation(q, v, p, metric=squared_euclidean):
    """For each part of the query its distance to the nearest part of the vector, summed."""
    return _sum(F.transform(_parts(q, p), lambda x: F.array_min(F.transform(_parts(v, p), lambda y: metric(x, y)))))


def product_of_parts(q, v, p, metric=squared_euclidean):
    """The first parts' distance times the second parts'."""
    return metric(F.slice(q, 1, p), F.slice(v, 1, p)) * metric(F.slice(q, p + 1, p), F.slice(v, p + 1, p))


def mobius(q, v, n, p, metric=squared_euclidean):
    """(recall, rank): the vector against the query's first n values, and against its n values from p on."""
    return metric(F.slice(q, 1, n), v), metric(F.slice(q, p + 1, n), v)


def relevance(q, v, p, metric=squared_euclidean):
    """(recall, rank): the permutation metric, and the first parts' distance."""
    return permutation(q, v, p, metric), metric(F.slice(q, 1, p), F.slice(v, 1, p))


# The same as kernels, for scans.


def _k_cells(q, v):
    both = np.bitwise_count(q & v).sum(axis=-1).astype(float)
    left, right = float(np.bitwise_count(q).sum()), np.bitwise_count(v).sum(axis=-1).astype(float)
    return both, left - both, right - both


def binary_kernel(metric: str, n: int):
    """A kernel on packed words of ``n`` bits."""

    def kernel(q, v):
        n11, n10, n01 = _k_cells(q, v)
        h = n10 + n01
        if metric == "hamming":
            return h
        if metric in ("matching", "sokal_michener"):
            return h / n
        if metric == "jaccard":
            return _div(h, n11 + h)
        if metric == "dice":
            return _div(h, 2 * n11 + h)
        if metric == "rogers_tanimoto":
            return 2 * h / (n + h)
        if metric == "russell_rao":
            return (n - n11) / n
        if metric == "sokal_sneath":
            return _div(2 * h, n11 + 2 * h)
        n00 = n - n11 - h
        return _div(2 * n10 * n01, n11 * n00 + n10 * n01)

    if metric not in BINARY:
        raise ValueError(f"unknown binary metric {metric}")
    return kernel


def _k_l2(q, v):
    return _seq((q - v) * (q - v))


def permutation_kernel(p: int, kernel=_k_l2):
    def f(q, v):
        parts = v.reshape(len(v), -1, p)
        return sum(np.stack([kernel(x, parts[:, j]) for j in range(parts.shape[1])]).min(axis=0) for x in q.reshape(-1, p))

    return f


def product_kernel(p: int, kernel=_k_l2):
    return lambda q, v: kernel(q[:p], v[:, :p]) * kernel(q[p : 2 * p], v[:, p : 2 * p])


def prefix_kernel(p: int, kernel=_k_l2):
    """The distance of the first p values."""
    return lambda q, v: kernel(q[:p], v[:, :p])


def mobius_kernel(n: int, p: int, kernel=_k_l2):
    """(recall, rank) of vectors cut to n values."""

    def f(q, v):
        return kernel(q[:n], v[:, :n]), kernel(q[p : p + n], v[:, :n])

    f.paired = True
    return f


def relevance_kernel(p: int, kernel=_k_l2):
    """(recall, rank)"""
    recall, rank = permutation_kernel(p, kernel), prefix_kernel(p, kernel)

    def f(q, v):
        return recall(q, v), rank(q, v)

    f.paired = True
    return f
