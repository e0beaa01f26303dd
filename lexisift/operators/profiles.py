"""Tables that characterise a corpus of featurised queries or questions. All are grouped aggregations with map-side combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formal import FORMS, OPERATORS
from ..functions.values import finite
from .stats import null_safe, percentiles, with_percentiles


def form_distribution(df: DataFrame, key: str = "domain") -> DataFrame:
    """(key, n, n_FORM, pct_FORM): shares of the query forms."""
    forms = (*FORMS, "UNKNOWN")
    c = {f: F.count_if(F.col("query_form") == f) for f in forms}
    return df.groupBy(key).agg(F.count("*").alias("n"), *[v.alias(f"n_{k}") for k, v in c.items()], *[F.round(100.0 * v / F.count("*"), 2).alias(f"pct_{k}") for k, v in c.items()])


def operator_profile(df: DataFrame, key: str = "domain") -> DataFrame:
    """(key, operator, mean, pct_nonzero) over the operators."""
    wide = df.groupBy(key).agg(*[F.round(F.avg(f"op_{k}"), 3).alias(f"m_{k}") for k in OPERATORS], *[F.round(100.0 * F.count_if(F.col(f"op_{k}") > 0) / F.count("*"), 1).alias(f"p_{k}") for k in OPERATORS])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("operator"), F.col(f"m_{k}").alias("mean"), F.col(f"p_{k}").alias("pct_nonzero")) for k in OPERATORS]))
    return wide.select(key, rows.alias("r")).select(key, "r.*")


def scalar_summary(df: DataFrame, metrics: list[str], key: str = "domain") -> DataFrame:
    """(metric, key, n, mean, median, std, min, max, p25, p75) of finite values, three decimals; exact percentiles."""
    long = df.select(key, *[finite(F.col(m)).alias(m) for m in metrics]).unpivot([key], metrics, "metric", "x").filter("x is not null")
    out = long.groupBy("metric", key).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = with_percentiles(out, long, ["metric", key], ["x"], {"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumnsRenamed({f"x_{c}": c for c in ("p25", "median", "p75")})
    return out.withColumns({c: F.round(F.col(c), 3) for c in ("mean", "median", "std", "min", "max", "p25", "p75")})


def nary_summary(df: DataFrame, key: str = "domain") -> DataFrame:
    return df.groupBy(key).agg(F.count_if(F.col("nary_count") > 0).alias("n_nary"), F.round(100.0 * F.count_if(F.col("nary_count") > 0) / F.count("*"), 1).alias("pct_nary"), F.round(F.avg("nary_count"), 3).alias("mean_nary"), F.max("nary_count").alias("max_nary"))


def boolean_features(df: DataFrame, columns=("has_negation", "has_annotation"), key: str = "domain") -> DataFrame:
    return df.groupBy(key).agg(*[F.round(100.0 * F.avg(F.col(c).cast("double")), 1).alias(f"pct_{c}") for c in columns])


def compositionality(df: DataFrame, columns=("operator_diversity", "join_count", "nesting_depth", "compositional_score"), key: str = "domain") -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.round(F.avg(c), 3).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 3).alias(f"{c}_std")]
    return _rounded(with_percentiles(df.groupBy(key).agg(*aggs), df, [key], list(columns), {"median": 0.5}), columns)


def _rounded(out: DataFrame, columns) -> DataFrame:
    return out.withColumns({f"{c}_median": F.round(f"{c}_median", 3) for c in columns})


def subgroups(df: DataFrame, columns=("complexity_score", "join_count", "nesting_depth", "operator_count", "compositional_score"), keys=("domain", "query_form"), least: int = 3) -> DataFrame:
    """Mean and median per subgroup of at least so many rows."""
    aggs = []
    for c in columns:
        aggs += [F.round(F.avg(c), 3).alias(f"{c}_mean")]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs).filter(F.col("n") >= least)
    return _rounded(with_percentiles(out, df, list(keys), list(columns), {"median": 0.5}), columns)


def domain_profile(df: DataFrame, key: str = "domain") -> DataFrame:
    """Aggregate profile: forms, complexity, operator shares, structure, size and diversity."""
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 1)
    shares = [pct(F.col("query_form") == f).alias(f"{f}_pct") for f in FORMS]
    ops = [pct(F.col(f"op_{o}") > 0).alias(f"pct_{o}") for o in ("FILTER", "OPTIONAL", "UNION", "FILTER_NOT_EXISTS", "SUBQUERY", "ORDER_BY", "DISTINCT", "GROUP_BY", "COUNT", "LIMIT")]
    means = [F.round(F.avg(c), 2).alias(f"mean_{c}") for c in ("operator_count", "operator_diversity", "join_count", "nesting_depth", "compositional_score", "entity_count", "class_count", "relation_count", "literal_count", "vocab_tokens")]
    out = df.groupBy(key).agg(
        F.count("*").alias("n_queries"), *shares, F.round(F.avg("complexity_score"), 2).alias("mean_complexity"), F.round(F.stddev_samp("complexity_score"), 2).alias("std_complexity"),
        *ops, *means, F.round(F.avg("ttr"), 4).alias("mean_ttr"), pct(F.col("nary_count") > 0).alias("pct_nary"),
    )
    return with_percentiles(out, df, [key], ["complexity_score"], {"median": 0.5}).withColumn("median_complexity", F.round("complexity_score_median", 2)).drop("complexity_score_median")


def levels(df: DataFrame) -> DataFrame:
    """df with one row per complexity level that a row belongs to; levels overlap, rows of none are dropped."""
    c = F.col("complexity_score")
    found = F.array_compact(
        F.array(
            F.when((c >= 0) & (c < 1), "Simple"), F.when((c >= 1) & (c < 3), "1-hop"), F.when((c >= 3) & (c < 7), "Multi-hop"),
            F.when((F.col("op_GROUP_BY") > 0) | (F.col("op_COUNT") > 0), "Aggregation"), F.when(F.col("has_negation") > 0, "Negation"),
        )
    )
    return df.withColumn("level", F.explode(found))


def representatives(df: DataFrame, id_col: str, keys=("domain", "level"), score: str = "complexity_score") -> DataFrame:
    """The row of each stratum closest to the stratum's median score, the lowest id on ties. Two aggregations, no window over a stratum."""
    med = percentiles(df, list(keys), [score], {"median": 0.5}).withColumnRenamed(f"{score}_median", "stratum_median")
    near = null_safe(df, med, list(keys)).withColumn("distance", F.abs(F.col(score) - F.col("stratum_median")))
    return near.groupBy(*keys).agg(F.min(F.struct("distance", id_col)).alias("r"), F.first("stratum_median").alias("stratum_median"), F.count("*").alias("n")).select(*keys, F.col(f"r.{id_col}").alias(id_col), "stratum_median", F.col("r.distance").alias("distance"), "n")


def surface_summary(df: DataFrame, metrics: list[str], key: str = "domain") -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(m), 3).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 3).alias(f"{m}_std")]
    return _rounded(with_percentiles(df.groupBy(key).agg(F.count("*").alias("n"), *aggs), df, [key], list(metrics), {"median": 0.5}), metrics)


def type_table(df: DataFrame, key: str = "domain", kind: str = "question_type") -> DataFrame:
    """(key, kind, n, pct): types and their share within the key."""
    c = df.groupBy(key, kind).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(key)), 2))
