"""Displacement of latent feature vectors between methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CHALLENGERS, finite
from ..functions.vectors import angle
from . import stats


def impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with more missing features than half their number (rounded down) go; other missing features become 0."""
    gone = sum((finite(F.col(f)).isNull().cast("int") for f in features), F.lit(0))
    return df.filter(gone <= len(features) // 2).withColumns({f: F.coalesce(finite(F.col(f)), F.lit(0.0)) for f in features})


def first_per_key(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The first non-null value of each column in the given order, per key."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def zscores(df: DataFrame, features: list[str]) -> DataFrame:
    """Features on the scale of the whole table: mean 0, population deviation 1; a deviation below 1e-12 counts as 1. One aggregate row is broadcast."""
    moments = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    j = df.crossJoin(F.broadcast(moments))
    return j.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") < 1e-12, 1.0).otherwise(F.col(f"_s_{f}")) for f in features}).select(*df.columns)


def signed_angles(df: DataFrame, features: list[str], sign_feature: str) -> DataFrame:
    """(domain, model, method, query_id, angle): degrees between a challenger's and the baseline's vector, negative if the sign feature fell."""
    v = df.select("domain", "model", "method", "query_id", F.array(*features).alias("v"), F.col(sign_feature).alias("s"))
    base = v.filter("method = 'nlq'").select("domain", "model", "query_id", F.col("v").alias("bv"), F.col("s").alias("bs"))
    j = v.filter(F.col("method").isin(*CHALLENGERS)).join(base, ["domain", "model", "query_id"])
    a = angle(F.col("v"), F.col("bv"))
    return j.select("domain", "model", "method", "query_id", F.when(F.col("s") - F.col("bs") < 0, -a).otherwise(a).alias("angle"))


def angle_stats(angles: DataFrame, keys=("domain", "model", "method")) -> DataFrame:
    """n, mean, median, std (0 for one value), Cohen's d, shares of positive and negative angles, and the signed-rank test."""
    a = F.col("angle")
    s = angles.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean"), F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("std"),
        F.round(100.0 * F.count_if(a > 0) / F.count("*"), 2).alias("pct_pos"), F.round(100.0 * F.count_if(a < 0) / F.count("*"), 2).alias("pct_neg"),
    )
    s = stats.with_percentiles(s, angles, list(keys), ["angle"], {"median": 0.5}).withColumnRenamed("angle_median", "median")
    s = s.withColumn("cohens_d", F.when(F.col("std") > 1e-12, F.round(F.col("mean") / F.col("std"), 4)))
    w = stats.wilcoxon(angles, list(keys), "angle", least=10).select(*keys, "statistic", "p")
    return stats.null_safe(s, w, list(keys), "left").withColumns({c: F.round(c, 4) for c in ("mean", "median", "std")})


def mean_angles(angles: DataFrame, keys=("domain", "model", "method")) -> DataFrame:
    """The mean angle of each cell, four decimals: what the two operators below need of angle_stats."""
    return angles.groupBy(*keys).agg(F.round(F.avg("angle"), 4).alias("mean"))


def largest_displacement(s: DataFrame, method: str = "sparql") -> DataFrame:
    """The cell of a method with the largest absolute mean angle; the first by model and domain on ties."""
    return s.filter(F.col("method") == method).orderBy(F.desc(F.abs("mean")), "model", "domain").limit(1).select("model", "domain", "method", "mean")


def direction_flips(s: DataFrame) -> DataFrame:
    """Cells with all challengers whose mean angles do not all point the same way."""
    return s.groupBy("model", "domain").agg(F.count("*").alias("n_methods"), F.count_distinct(F.signum("mean")).alias("n_signs")).filter(f"n_methods = {len(CHALLENGERS)} and n_signs > 1")


def plot_limits(s: DataFrame, keys=("domain",), lo: str = "lo", hi: str = "hi", default: float = 30.0) -> DataFrame:
    """(keys, low, high): symmetric axis limits from interval ends, 1.22 times the largest absolute end plus 3; the default without any."""
    most = F.max(F.greatest(F.abs(finite(F.col(lo))), F.abs(finite(F.col(hi))))) * 1.22 + 3
    return s.groupBy(*keys).agg(F.round(F.coalesce(most, F.lit(default)), 4).alias("high")).select(*keys, (-F.col("high")).alias("low"), "high")


def domain_order(domain: Column, first=("TelcoQA", "FiQA", "LegalQA")) -> list[Column]:
    """Sort keys that put the named domains first, in order, and the others after them by name."""
    at = F.array_position(F.array(*[F.lit(x) for x in first]), domain)
    return [F.when(at > 0, at).otherwise(len(first) + 1).asc(), domain.asc()]
