"""Distribution functions as column expressions: normal and chi-square tails, effect sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal tail (absolute error below 7.5e-8).
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_P = 0.2316419


def normal_tail(z: Column) -> Column:
    """P(Z > |z|)."""
    x = F.abs(z)
    t = F.lit(1.0) / (1.0 + _P * x)
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = (poly + b) * t
    return F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly


def normal_tail_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + {_P} * abs({z})))"
    poly = "0.0"
    for b in reversed(_B):
        poly = f"(({poly} + {b}) * {t})"
    return f"(exp(-({z}) * ({z}) / 2.0) / {math.sqrt(2 * math.pi)} * {poly})"


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X > x) for whole degrees of freedom, by the finite series; its terms are folded over a sequence, so the expression stays small."""
    half, root, m = x / 2.0, F.sqrt(x), F.floor(df / 2)
    steps = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1))), lambda i: i <= F.when(df % 2 == 0, m - 1).otherwise(m))
    even = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * half / i).alias("t"), (a["s"] + a["t"] * half / i).alias("s")), lambda a: a["s"])
    odd = F.aggregate(steps, F.struct(root.alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * x / (2 * i + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(df % 2 == 0, F.exp(-half) * even).otherwise(2.0 * normal_tail(root) + 2.0 * F.exp(-half) / math.sqrt(2 * math.pi) * odd)


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Two-sample d with pooled sample variance; null if a group has fewer than two values, 0 if nothing varies."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2), F.when(pooled == 0, 0.0).otherwise((m1 - m2) / pooled))


def epsilon_squared(h: Column, k: Column, n: Column) -> Column:
    return F.when(n > k, (h - k + 1) / (n - k))
