"""Vector functions over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda v: v.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is shorter than 1e-12."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))


def alignment_recall(reference: Column, candidate: Column) -> Column:
    """Mean over the reference's token vectors of the greatest cosine with one of the candidate's; null if either has none. Vectors are
    arrays of arrays, as an embedder gives them."""
    best = F.transform(reference, lambda r: F.array_max(F.transform(candidate, lambda c: cosine(r, c))))
    return F.when((F.size(reference) > 0) & (F.size(candidate) > 0), F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(reference))
