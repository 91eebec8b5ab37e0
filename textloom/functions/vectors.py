"""Column functions over array<float> vectors; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scaled = F.transform(F.array(F.struct(as_double(v).alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x).otherwise(x / s["n"])))
    return F.get(scaled, F.lit(0))


def truncate(v: Column, dims: int) -> Column:
    """The first dimensions, then unit length."""
    return normalize(F.slice(v, 1, dims))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1; zeros if none is."""
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    pairs = F.zip_with(tokens, mask, lambda t, m: F.struct(as_double(t).alias("t"), m.cast("double").alias("m")))
    sums = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["t"], lambda a, x: a + x * p["m"]))
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(sums, lambda x: x / total)


def binary_code(v: Column) -> Column:
    """A bit per dimension, 1 where positive, eight to a number, the lowest bit first."""
    n = F.ceil(F.size(v) / 8).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, i: s + F.when(F.get(v, b * 8 + i) > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)),
    )


def binary_decode(code: Column, dims: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.call_function("shiftright", F.get(code, F.floor(i / 8).cast("int")), i % 8).bitwiseAND(1) == 1, 1).otherwise(-1))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def int8_code(v: Column, low: Column, scale: Column) -> Column:
    """Truncated steps above `low`, shifted to -128..127."""
    return F.transform(as_double(v), lambda x: (F.floor((x - low) / scale) - 128).cast("int"))


def int8_decode(code: Column, low: Column, scale: Column) -> Column:
    return F.transform(code, lambda q: (q + 128) * scale + low)
