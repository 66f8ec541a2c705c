"""Vectors as Column expressions in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of doubles of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles; null if one is null, 0 if one is zero."""

    def of(x: Column, y: Column) -> Column:
        product = dot(x, y)
        return F.when(product.isNotNull(), F.coalesce(F.try_divide(product, norm(x) * norm(y)), F.lit(0.0)))

    return bound(a, lambda x: bound(b, lambda y: of(x, y)))


def cosine_with(vector: Column, query: list[float]) -> Column:
    """The cosine with a fixed query vector, whose norm is computed once."""
    length = math.sqrt(sum(x * x for x in query))
    fixed = F.array(*(F.lit(float(x)) for x in query))
    v = doubles(vector)
    product = dot(v, fixed)
    return F.when(product.isNotNull(), F.coalesce(F.try_divide(product, norm(v) * F.lit(length)), F.lit(0.0)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fit(vector: Column, width: int) -> Column:
    """The vector cut or padded with zeros to ``width`` and scaled to length one; a zero vector stays zero."""

    def scaled(cut: Column) -> Column:
        return bound(norm(cut), lambda n: F.when(n > 0, F.transform(cut, lambda x: x / n)).otherwise(cut))

    v = doubles(vector)
    return bound(F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width), scaled)


def hashed(text: Column, width: int) -> Column:
    """A vector that stands in for an embedding where no model is at hand: the bytes of chained digests, as angles'
    sines, scaled to length one. Equal texts have equal vectors; it says nothing about likeness of meaning."""
    said = F.coalesce(text, F.lit(""))
    digests = F.array(*(F.sha2(F.concat(F.lit(f"{i}:"), said), 256) for i in range(-(-width // 32))))

    def values(digest: Column) -> Column:
        def value(i: Column) -> Column:
            return F.sin(F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * (2 * math.pi))

        return F.transform(F.sequence(F.lit(0), F.lit(31)), value)

    return fit(F.flatten(F.transform(digests, values)), width)
