"""Vector arithmetic over array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def unit(a: Column) -> Column:
    """L2-normalised doubles; a zero vector stays zero."""

    def over(size: Column) -> Column:
        return F.transform(a, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x.cast("double") / F.nullif(size, F.lit(0.0))))

    # An array of the norm alone: named in the inner lambda itself, the norm would be computed again for every element.
    return F.transform(F.array(norm(a)), over)[0]


def to_literal(a: Column) -> Column:
    """``[a,b,…]`` text form of a vector."""
    return F.to_json(a)


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")
