"""Rank statistics over columns of any size: ranks by buckets with prefix sums, so that no task sorts a whole metric."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import stats as S
from ..functions.values import finite
from ..session import durable, spec

BUCKETS, COARSE = 1024, 32  # parts of each key's values; one in COARSE cuts is looked at first


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; b has nothing else in common with a."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return a.join(b, on, how).drop(*[f"_k_{k}" for k in keys])


def values_below(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counted (keys, value, ties; one row per distinct value) with below, the number of rows of the key with a smaller value.

    Values fall into buckets by approximate quantiles of their key; below is a prefix sum of bucket totals plus one inside the bucket, so no
    task sorts all values of a key."""
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("_cuts"))
    cuts = cuts.withColumn("_first", F.filter("_cuts", lambda c, i: i % COARSE == 0))
    j = null_safe(counted, cuts, keys).withColumn("_c", F.size(F.filter("_first", lambda c: c < F.col(value))))
    j = j.withColumn("_part", F.slice("_cuts", F.greatest(F.col("_c") - 1, F.lit(0)) * COARSE + 1, F.lit(COARSE))).drop("_cuts", "_first")
    b = j.withColumn("_b", F.greatest(F.col("_c") - 1, F.lit(0)) * COARSE + F.size(F.filter("_part", lambda c: c < F.col(value)))).drop("_part", "_c")
    totals = b.groupBy(*keys, "_b").agg(F.sum("ties").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return null_safe(b.withColumn("_in", F.coalesce(F.sum("ties").over(inside), F.lit(0))), offs, [*keys, "_b"]).withColumn("below", F.col("_off") + F.col("_in")).select(*keys, value, "ties", "below")


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, ties, rank): the average rank of every distinct value within its key. Equal values are combined first."""
    counted = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("ties"))
    return values_below(counted, keys, value).select(*keys, value, "ties", (F.col("below") + (F.col("ties") + 1) / 2.0).alias("rank"))


def percentiles(df: DataFrame, keys: list[str], metrics: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(keys, {metric}_{name}): exact percentiles with linear interpolation of the finite values of each metric, from counts of smaller values;
    null without values. No buffer grows with a key, as that of the built-in exact percentile does."""
    long = df.select(*keys, *[finite(F.col(m).cast("double")).alias(m) for m in metrics]).unpivot(keys, metrics, "_m", "_x").filter("_x is not null")
    counted = durable(long.groupBy(*keys, "_m", "_x").agg(F.count("*").alias("ties")))
    by = [*keys, "_m"]
    n = counted.groupBy(*by).agg(F.sum("ties").alias("_n"))
    at = null_safe(values_below(counted, by, "_x"), n, by)
    pos = {k: F.lit(q) * (F.col("_n") - 1) for k, q in quantiles.items()}
    here = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("ties")), F.col("_x")))
    found = at.groupBy(*by).agg(F.max("_n").alias("_n"), *[here(f(pos[k])).alias(f"_{e}_{k}") for k in quantiles for e, f in (("lo", F.floor), ("hi", F.ceil))])
    value = {k: F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (pos[k] - F.floor(pos[k])) for k in quantiles}
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == m, value[k])).alias(f"{m}_{k}") for m in metrics for k in quantiles])


def with_percentiles(out: DataFrame, df: DataFrame, keys: list[str], metrics: list[str], quantiles: dict[str, float]) -> DataFrame:
    """out, one row per keys, with the percentiles of df."""
    return null_safe(out, percentiles(df, keys, metrics, quantiles), keys, "left")


def kruskal(df: DataFrame, metrics: list[str], group: str, least: int = 3) -> DataFrame:
    """(metric, k, n, h, p, epsilon_sq, effect, verdict): Kruskal-Wallis with tie correction over groups of at least so many finite values.

    Fewer than two groups or constant data are Skipped, with null figures."""
    g = kruskal_groups(df, metrics, group, least)
    ties = g["ties"]
    total = g["groups"].groupBy("metric").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    j = total.join(ties, "metric", "left")
    n = F.col("n").cast("double")
    corr = 1 - F.coalesce(F.col("t3"), F.lit(0.0)) / (n * n * n - n)
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), corr)
    j = j.withColumn("_h", F.when((F.col("k") >= 2) & (corr > 1e-12), h))
    p = S.chi2_tail(F.col("_h"), F.col("k") - 1)
    eps = S.epsilon_squared(F.col("_h"), F.col("k"), n)
    return j.select("metric", "k", "n", F.round("_h", 3).alias("h"), F.round(p, 5).alias("p"), F.round(eps, 4).alias("epsilon_sq"), F.when(p.isNull(), "Skipped").when(p < 0.05, "Yes").otherwise("No").alias("significant"))


def kruskal_groups(df: DataFrame, metrics: list[str], group: str, least: int = 3) -> dict[str, DataFrame]:
    """groups: (metric, group, n, rank_sum, mean, var); ties: (metric, t3)."""
    long = df.select(F.col(group).alias("group"), *[finite(F.col(m)).alias(m) for m in metrics]).unpivot(["group"], metrics, "metric", "x").filter("x is not null and group is not null")
    # distinct values only, written once and read by the ranks, the ties and the group sums
    counted = durable(long.groupBy("metric", "group", "x").agg(F.count("*").alias("c")))
    keep = counted.groupBy("metric", "group").agg(F.sum("c").alias("n")).filter(F.col("n") >= least)
    counted = counted.join(keep.drop("n"), ["metric", "group"], "left_semi")
    ranks = average_ranks(counted, ["metric"], "x", "c")
    t3 = ranks.groupBy("metric").agg(F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("t3"))
    j = counted.join(ranks.select("metric", "x", "rank"), ["metric", "x"])
    w = F.col("c").cast("double")
    g = j.groupBy("metric", "group").agg(F.sum("c").alias("n"), F.sum(w * F.col("rank")).alias("rank_sum"), (F.sum(w * F.col("x")) / F.sum(w)).alias("mean"), F.sum(w * F.col("x") * F.col("x")).alias("_xx"), F.sum(w * F.col("x")).alias("_x"))
    var = F.greatest(F.lit(0.0), (F.col("_xx") - F.col("_x") * F.col("_x") / F.col("n")) / (F.col("n") - 1))
    return {"groups": g.withColumn("var", var).drop("_xx", "_x"), "ties": t3}


def dunn(df: DataFrame, metrics: list[str], group: str, least: int = 3) -> DataFrame:
    """(metric, group_a, group_b, z, p_adj, d, d_size): Dunn's test of all group pairs, Bonferroni adjusted, with Cohen's d. The pairs are
    those of a metric's groups, not of rows."""
    g = kruskal_groups(df, metrics, group, least)["groups"]
    g = g.withColumns({"_n": F.sum("n").over(Window.partitionBy("metric")), "_k": F.count("*").over(Window.partitionBy("metric"))})
    a, b = g.alias("a"), g.alias("b")
    j = a.join(b, (F.col("a.metric") == F.col("b.metric")) & (F.col("a.group") < F.col("b.group")))
    n = F.col("a._n").cast("double")
    se = F.sqrt(n * (n + 1) / 12.0 * (1.0 / F.col("a.n") + 1.0 / F.col("b.n")))
    z = (F.col("a.rank_sum") / F.col("a.n") - F.col("b.rank_sum") / F.col("b.n")) / se
    m = F.col("a._k") * (F.col("a._k") - 1) / 2
    d = S.cohens_d(F.col("a.n"), F.col("a.mean"), F.col("a.var"), F.col("b.n"), F.col("b.mean"), F.col("b.var"))
    return j.select(F.col("a.metric").alias("metric"), F.col("a.group").alias("group_a"), F.col("b.group").alias("group_b"), F.round(z, 4).alias("z"), F.round(F.least(F.lit(1.0), 2 * S.normal_tail(z) * m), 5).alias("p_adj"), F.round(d, 4).alias("d"))


def wilcoxon(df: DataFrame, keys: list[str], delta: str, least: int = 5, most_exact: int = 50) -> DataFrame:
    """(keys, n_nonzero, w_plus, w_minus, statistic, z, p): signed-rank test of the differences against 0; zeros dropped. p is exact
    up to most_exact differences without ties or zeros, else the normal approximation with tie correction and without continuity correction,
    as z always is. Null figures below least non-zero differences."""
    x = df.select(*keys, finite(F.col(delta)).alias("d")).filter("d is not null")
    every = durable(x.groupBy(*keys, F.abs("d").alias("a")).agg(F.count_if(F.col("d") > 0).alias("pos"), F.count("*").alias("t")))
    c = every.filter("a <> 0")
    zeros = every.filter("a = 0").select(*[F.col(k).alias(f"_z{i}") for i, k in enumerate(keys)], F.col("t").alias("_zeros"))
    r = average_ranks(c, keys, "a", "t").select(*keys, "a", "rank")
    j = c.join(r, [*keys, "a"])
    t = F.col("t").cast("double")
    s = j.groupBy(*keys).agg(F.sum("t").alias("n_nonzero"), F.sum(F.col("pos") * F.col("rank")).alias("w_plus"), F.sum((F.col("t") - F.col("pos")) * F.col("rank")).alias("w_minus"), F.sum(t * t * t - t).alias("_t3"))
    same = [s[k].eqNullSafe(zeros[f"_z{i}"]) for i, k in enumerate(keys)]
    s = s.join(zeros, functools.reduce(lambda a, b: a & b, same), "left")
    n = F.col("n_nonzero").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_t3") / 2.0) / 24.0)
    stat = F.least("w_plus", "w_minus")
    z = (stat - n * (n + 1) / 4.0) / se
    ok = F.col("n_nonzero") >= least
    exact = ok & (F.col("n_nonzero") <= most_exact) & (F.col("_t3") == 0) & F.col("_zeros").isNull()
    return s.select(*keys, "n_nonzero", "w_plus", "w_minus", F.when(ok, F.round(stat, 4)).alias("statistic"), F.when(ok, F.round(z, 4)).alias("z"), F.when(ok, F.round(F.when(exact, _exact_p(F.when(exact, F.col("n_nonzero")), stat)).otherwise(2 * S.normal_tail(z)), 6)).alias("p"))


@F.pandas_udf(DoubleType())
def _exact_p(n: pd.Series, statistic: pd.Series) -> pd.Series:
    return pd.Series([exact_wilcoxon_p(int(k), float(w)) if k == k else None for k, w in zip(n, statistic)], dtype="float64")


def exact_wilcoxon_p(n: int, statistic: float) -> float:
    """Two-sided exact probability of min(W+, W-) for n differences without ties or zeros, by counting rank sums."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r] if r else ways
    p = ways[: int(math.floor(statistic)) + 1].sum() / 2.0**n
    return float(min(1.0, 2 * p))


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: str | None = None, draws: int = 2000, seed: int = 42, level: float = 0.95, per_bucket: int = 50_000) -> DataFrame:
    """(keys, n, mean, lo, hi): percentile interval of the mean by resampling; (mean, mean) below three values.

    One scheme for groups of any size: a group's values are combined to a histogram, and a draw takes multinomial counts over it. The
    histogram is spread over buckets by hash, so many that one holds about per_bucket distinct values: each draw first shares n out over
    the buckets (every bucket repeats that draw from the same seed), then each bucket draws its share from its own values, and the sums
    of the buckets are added. order is kept for callers; the result doesn't depend on it."""
    head = spec(df, keys)
    x = df.select(*keys, finite(F.col(value).cast("double")).alias("_v")).filter("_v is not null")
    counted = durable(x.groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.count("*") / per_bucket).cast("int").alias("_k"))
    placed = null_safe(counted, sizes, keys).withColumn("_b", F.pmod(F.xxhash64("_v"), F.col("_k")).cast("int"))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_t"))).alias("_all"))  # one entry a bucket

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        all_ = g["_all"].iloc[0]
        bucket = int(g["_b"].iloc[0])
        shares = np.array([r["_t"] for r in all_], dtype=float)
        at = [r["_b"] for r in all_].index(bucket)
        n = int(shares.sum())
        mine = np.random.default_rng(seed).multinomial(n, shares / n, size=draws)[:, at] if len(shares) > 1 else np.full(draws, n)
        rng = np.random.default_rng([seed, bucket])
        g = g.sort_values("_v")
        v, c = g["_v"].to_numpy(), g["_c"].to_numpy(float)
        step = max(1, 2_000_000 // len(v))  # draws at a time, to bound memory
        sums = np.concatenate([rng.multinomial(mine[i : i + step], c / c.sum()) @ v for i in range(0, draws, step)])
        return pd.DataFrame([[*key[: len(keys)], int(c.sum()), float(v @ c), sums]], columns=[*keys, "n", "total", "sums"])

    parts = durable(null_safe(placed, totals, keys).groupBy(*keys, "_b").applyInPandas(one, f"{head}, n bigint, total double, sums array<double>"))
    i = F.posexplode("sums").alias("i", "s")
    summed = parts.select(*keys, i).groupBy(*keys, "i").agg(F.sum("s").alias("s"))
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    ends = summed.groupBy(*keys).agg(F.percentile("s", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("e"))  # draws values a group
    j = null_safe(whole, ends, keys)
    mean = F.col("total") / F.col("n")
    end = lambda k: F.when(F.col("n") < 3, mean).otherwise(F.col("e")[k] / F.col("n"))
    return j.select(*keys, "n", mean.alias("mean"), end(0).alias("lo"), end(1).alias("hi"))
