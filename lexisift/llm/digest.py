"""Problem 5: percentiles from merging centroid digests with certified rank error.

A digest of a group is a bounded set of centroids (n, mean, lo, hi): values sorted, cut where a quantile-dependent size function
steps, so that centroids are small at both ends. Digests of parts are merged by sorting their centroids and clustering again.
Each centroid keeps the least and greatest value in it, which bounds the rank of any value exactly; a second pass counts ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import durable, spec

DELTA = 200  # about half as many centroids a digest
QUANTILES = (0.25, 0.5, 0.75)
MARGIN = 0.05


def cluster(group: np.ndarray, n: np.ndarray, mean: np.ndarray, lo: np.ndarray, hi: np.ndarray, delta: int = DELTA):
    """Cluster weighted centroids of many groups at once, each sorted by mean: a new centroid starts where the arcsine scale of the
    middle rank takes a step. group holds numbers from 0."""
    order = np.lexsort((hi, lo, mean, group))
    group, n, mean, lo, hi = group[order], n[order], mean[order], lo[order], hi[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    end = np.cumsum(n)
    before = np.repeat(end[first] - n[first], size)
    total = np.repeat(np.add.reduceat(n, first), size)
    q = (end - before - n / 2) / total
    k = np.floor(delta / (2 * math.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)))
    at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (group[1:] != group[:-1])])
    w = np.add.reduceat(n, at)
    return group[at], w, np.add.reduceat(mean * n, at) / w, np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def _squeeze(frames: list[pd.DataFrame], keys: list[str], delta: int) -> pd.DataFrame:
    t = pd.concat(frames, ignore_index=True)
    groups = t.groupby(keys, sort=False, dropna=False)
    g, w, m, lo, hi = cluster(groups.ngroup().to_numpy(), t.n.to_numpy(float), t["mean"].to_numpy(), t.lo.to_numpy(), t.hi.to_numpy(), delta)
    names = t.loc[~t.duplicated(keys), keys].reset_index(drop=True).iloc[g].reset_index(drop=True)
    return names.assign(n=w.astype("int64"), mean=m, lo=lo, hi=hi)


def _digest(rows: DataFrame, keys: list[str], delta: int, buffer: int) -> DataFrame:
    """Digest of the rows (keys, n, mean, lo, hi) of each partition, clustered whenever buffer rows have come, so a worker's memory is
    bounded by the buffer and the digests of the keys it meets."""
    head = spec(rows, keys) + ", n bigint, mean double, lo double, hi double"
    schema = to_arrow_schema(_parse_datatype_string(head))

    def run(batches):
        held, size, kept = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(b.to_pandas())
                size += b.num_rows
            if size >= buffer + 2 * kept:
                held = [_squeeze(held, keys, delta)]
                size = kept = len(held[0])
        if held:
            out = _squeeze(held, keys, delta)
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pandas(out.iloc[at : at + 10_000], preserve_index=False, schema=schema)

    return rows.select(*keys, "n", "mean", "lo", "hi").mapInArrow(run, head)


def partial_digests(values: DataFrame, keys: list[str], value: str, delta: int = DELTA, buffer: int = 200_000) -> DataFrame:
    """One digest per key and input partition, before any shuffle: (keys, n, mean, lo, hi). Null, NaN and infinite values don't count."""
    v = values.select(*keys, F.col(value).cast("double").alias("mean")).filter(F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < F.lit(float("inf"))))
    return _digest(v.withColumns({"n": F.lit(1).cast("bigint"), "lo": F.col("mean"), "hi": F.col("mean")}), keys, delta, buffer)


def merge_digests(digests: DataFrame, keys: list[str], delta: int = DELTA, buffer: int = 200_000) -> DataFrame:
    """Merge digests by clustering their centroids again: (keys, n, mean, lo, hi), about delta / 2 rows per key. A hot key brings as many
    centroids as partitions held it, never its values."""
    return _digest(digests.repartition(*keys), keys, delta, buffer)


def quantiles_from(digests: DataFrame, keys: list[str], quantiles=QUANTILES) -> DataFrame:
    """(keys, n, q, estimate, rank_error): the quantile from a merged digest and the certified bound of its rank error, as a share of n.

    The estimate is the mean of the centroid that holds the rank; every value it may stand for lies between that centroid's
    extremes, so the rank error is at most the weight of all centroids whose range meets the estimate."""
    d = digests.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("mean", "n", "lo", "hi"))).alias("c"))
    out = d.select(*keys, "n", "c", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    step = F.aggregate(
        "c",
        F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("x")),
        lambda a, c: F.struct((a["seen"] + c["n"]).alias("seen"), F.when(a["x"].isNull() & (a["seen"] + c["n"] >= F.col("q") * F.col("n")), c["mean"]).otherwise(a["x"]).alias("x")),
    )["x"]
    out = out.withColumn("estimate", step)
    low = F.aggregate("c", F.lit(0.0), lambda a, c: a + F.when(c["hi"] < F.col("estimate"), c["n"]).otherwise(0).cast("double"))
    high = F.aggregate("c", F.lit(0.0), lambda a, c: a + F.when(c["lo"] <= F.col("estimate"), c["n"]).otherwise(0).cast("double"))
    n = F.col("n").cast("double")
    return out.select(*keys, "n", "q", "estimate", F.greatest(F.abs(F.col("q") - low / n), F.abs(high / n - F.col("q"))).alias("rank_error"))


def rank_bounds(digests: DataFrame, figures: DataFrame, keys: list[str], value: str) -> DataFrame:
    """figures with n, and bounds of the number of values below and of values not above the figure, from the digests alone."""
    f = figures.withColumn("_row", F.monotonically_increasing_id())
    j = f.join(digests.select(*keys, "n", "lo", "hi"), keys, "left")
    v = F.col(value)
    c = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    g = [x for x in f.columns]
    return j.groupBy(*g).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), c(F.col("hi") < v).alias("below_least"), c(F.col("lo") < v).alias("below_most"), c(F.col("hi") <= v).alias("upto_least"), c(F.col("lo") <= v).alias("upto_most")
    )


def valid_features(features: DataFrame) -> DataFrame:
    """The row of each feature_id with the latest ingested_at; of equal times the greatest row in column order. Only needed columns are shuffled."""
    cols = ["release_tag", "domain", "run_date", "complexity_score", "compositional_score", "char_count"]
    row = F.struct("ingested_at", *cols)
    best = features.groupBy("feature_id").agg(F.max(row).alias("r"))
    return best.select("feature_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def feature_values(features: DataFrame) -> DataFrame:
    """(release_tag, dkey, day, metric, v) of the valid rows, numeric values only."""
    valid = valid_features(features)
    v = valid.select("release_tag", F.lower(F.trim("domain")).alias("dkey"), F.to_date("run_date").alias("day"), "complexity_score", "compositional_score", F.col("char_count").cast("double").alias("char_count"))
    long = v.unpivot(["release_tag", "dkey", "day"], ["complexity_score", "compositional_score", "char_count"], "metric", "v")
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))


def daily_digests(features: DataFrame) -> DataFrame:
    """Digests kept per day: (release_tag, dkey, day, metric, n, mean, lo, hi). Later days only add rows."""
    keys = ["release_tag", "dkey", "metric", "day"]
    return merge_digests(partial_digests(feature_values(features), keys, "v"), keys)


def keep_days(features: DataFrame, path: str) -> DataFrame:
    """The digests of the store at path, brought up to date: days that the store does not have are digested and appended, one folder a day;
    days it has are not read again, so a day must be complete when it is first kept. A corrected day is replaced by deleting its folder.

    Rows of feature_id that a later day corrects are judged by all features, as everywhere: only new days of valid rows are kept."""
    spark = features.sparkSession
    keys = ["release_tag", "dkey", "metric", "day"]
    values = feature_values(features)
    old = stored_days(spark, path)
    if old is not None:
        values = values.join(F.broadcast(old.select("day").distinct()), "day", "left_anti")  # one row a day
    merge_digests(partial_digests(values, keys, "v"), keys).write.mode("append").partitionBy("day").parquet(path)
    kept = stored_days(spark, path)
    return kept if kept is not None else merge_digests(partial_digests(values, keys, "v"), keys)


def stored_days(spark, path: str) -> DataFrame | None:
    """The digests kept at path, or None if there are none yet. Days without a date stand under a folder of their own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if not fs.exists(at) or not any(f.isDirectory() for f in fs.listStatus(at)):
        return None
    names = ["release_tag", "dkey", "metric", "day", "n", "mean", "lo", "hi"]
    return spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("date")).select(*names)


def wrong_figures(features: DataFrame, summary: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Rows of the summary in which a published quartile or median is wrong: (release_tag, metric, domain).

    The digests bound the rank of each figure. A figure whose bounds settle the question needs no more; the ranks of the open
    ones are counted exactly in a second pass over the values of their groups. A null or NaN figure is wrong; a group without
    values refutes nothing. daily: digests kept from earlier runs (keep_days); without them all days are digested anew."""
    keys = ["release_tag", "dkey", "metric"]
    values = durable(feature_values(features))
    day_keys = [*keys, "day"]
    if daily is None:
        daily = merge_digests(partial_digests(values, day_keys, "v"), day_keys)
    merged = durable(merge_digests(daily, keys))
    names = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    s = summary.select("release_tag", "metric", "domain", F.lower(F.trim("domain")).alias("dkey"), *[F.col(c).cast("double").alias(c) for c in names]).dropDuplicates()
    figures = s.select("release_tag", "metric", "domain", "dkey", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("x")) for c, q in names.items()])).alias("f")).select("release_tag", "metric", "domain", "dkey", "f.q", "f.x")
    bounded = durable(rank_bounds(merged, figures, keys, "x").drop("_row"))
    n = F.col("n").cast("double")
    bad = lambda below, upto: (below / n > F.col("q") + MARGIN) | (upto / n < F.col("q") - MARGIN)
    missing = F.col("x").isNull() | F.isnan("x")
    sure_wrong = (F.col("n") > 0) & (missing | bad(F.col("below_least"), F.col("upto_most")))
    sure_right = (F.col("n") == 0) | (~missing & ~bad(F.col("below_most"), F.col("upto_least")))
    state = bounded.withColumn("state", F.when(sure_wrong, "wrong").when(sure_right, "right").otherwise("open"))
    open_ = state.filter("state = 'open'").select(*keys, "domain", "q", "x", "n")
    # second counting pass: equal values are combined per partition before the shuffle, then meet the open figures of their group
    tally = values.join(open_.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    counted = tally.join(open_, keys).groupBy(*keys, "domain", "q", "x", "n").agg(total(F.col("v") < F.col("x")).alias("below"), total(F.col("v") <= F.col("x")).alias("upto"))
    wrong = state.filter("state = 'wrong'").select("release_tag", "metric", "domain").unionByName(counted.filter(bad(F.col("below"), F.col("upto"))).select("release_tag", "metric", "domain"))
    return wrong.distinct()
