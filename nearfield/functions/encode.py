"""Encoders and transforms of vectors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def sq8_encode(v: Column, lo, hi) -> Column:
    """8-bit codes: clamped shares of [lo, hi] times 255, cut down to integers."""
    span = hi - lo
    return F.transform(_doubles(v), lambda x: F.floor(F.least(F.greatest((x - lo) / span, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def sq8_decode(c: Column, lo, hi) -> Column:
    """Middles of the codes' intervals."""
    return F.transform(c, lambda x: lo + (x + 0.5) / 255 * (hi - lo))


def quantized(v: Column, scale: float, kind: str) -> Column:
    """Integers nearest to ``scale`` times each value, halves up."""
    return F.transform(_doubles(v), lambda x: F.floor(x * scale + 0.5).cast(kind))


def norm2(v: Column) -> Column:
    return F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def mips_document(v: Column, longest, m: int, u: float) -> Column:
    """Scaled below norm u, with m terms 1/2 - |x|^(2^i): inner products become distances."""
    scaled = F.transform(_doubles(v), lambda x: x * (u / longest))
    n2 = norm2(scaled)
    terms, power = [], n2
    for _ in range(m):
        terms.append(0.5 - power)
        power = power * power
    return F.concat(scaled, F.array(*terms))


def mips_query(v: Column, m: int) -> Column:
    return F.concat(_doubles(v), F.array_repeat(F.lit(0.0), m))


def mips_score(squares: Column, dist: Column, longest, m: int, u: float) -> Column:
    """The inner product that a distance stands for; ``squares`` is the query's squared norm. The number of terms is
    divided by 4 as a whole number."""
    return (squares + m // 4 - dist) / 2 * (longest / u)


def mips_centroid_terms(v: Column, centroid: Column, longest) -> tuple[Column, Column]:
    """Of the one-dimension form: (offline: the squared difference of the vector's further dimension and the centroid's,
    online: the centroid's squared). ``centroid`` has the further dimension at its end."""
    last = F.element_at(centroid, -1)
    apart = mips_extra(v, longest) - last
    return apart * apart, last * last


def rank_score_label(label: Column) -> Column:
    """As product-quantised indexes store it: the label and one, without a logarithm."""
    return label.cast("double") + 1


def mips_extra(v: Column, longest) -> Column:
    """The one further dimension that gives all vectors the same norm."""
    return F.sqrt(F.greatest(longest * longest - norm2(v), F.lit(0.0)))


def residual(v: Column, centroid: Column) -> Column:
    return F.zip_with(v, centroid, lambda x, y: x.cast("double") - y.cast("double"))


def fragment(v: Column, f: Column, width: int) -> Column:
    return F.slice(v, f * width + 1, width)


def sign_bits(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def note_seconds(note: Column) -> Column:
    """Creation time of a 24-character id: its first 8 hexadecimal digits."""
    return F.when((F.char_length(note) == 24) & F.substring(note, 1, 8).rlike("^[0-9A-Fa-f]{8}$"), F.conv(F.substring(note, 1, 8), 16, 10).cast("long"))


def rank_score(groups: Column, level: int) -> Column:
    """ln(id + 1) summed over the groups of a level."""
    return F.aggregate(F.filter(groups, lambda g: g["level"] == level), F.lit(0.0), lambda s, g: s + F.log(g["id"].cast("double") + 1))
