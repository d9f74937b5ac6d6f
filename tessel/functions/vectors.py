"""Vector functions over array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest finite 32-bit float.
FLOAT32_MAX = 3.4028234663852886e38


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def score(metric: str, v: Column, q: Column) -> Column:
    """Higher is better: cosine, dot product or negative distance."""
    if metric == "cosine":
        return cosine(v, q)
    if metric == "dot":
        return dot(v, q)
    if metric == "l2":
        return F.lit(0.0) - l2(v, q)
    raise ValueError(f"no metric {metric}")


def is_finite(v: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    return (F.size(v) > 0) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def to_float32(v: Column) -> Column:
    """Rounded to 32 bits; null where an entry is beyond the range."""
    return F.when(is_finite(v) & F.forall(doubles(v), lambda x: F.abs(x) <= FLOAT32_MAX), v.cast("array<float>"))


def from_json_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def hash_vector(text: Column, dims: int = 128) -> Column:
    """Deterministic test embedding: bytes of the SHA-256 of the text, spread and normalised."""
    # each step is bound once: a lambda would work out what it refers to for every entry
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    byte = lambda digest, i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    raw = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(byte(digest, i) * (i + 1), F.lit(256)) / 127.5 - 1)
    norm_of = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda v: once(norm_of(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v))
    return once(F.sha2(text, 256), lambda digest: once(raw(digest), scaled))
