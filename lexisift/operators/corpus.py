"""Corpus statistics: TF-IDF between groups, self-BLEU, lexical diversity, embedding similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import durable
from .stats import null_safe


def tfidf(df: DataFrame, group: str, tokens: Column, most: int | None = 5000, min_df: int = 1) -> DataFrame:
    """(group, term, tf, df, weight): each group is one document; smooth idf ln((1 + N) / (1 + df)) + 1, Euclidean norm 1.

    most keeps the terms of highest corpus count, by term on ties. Tokens are counted per partition before any shuffle."""
    tf = df.select(F.col(group).alias("group"), F.explode(tokens).alias("term")).groupBy("group", "term").agg(F.count("*").alias("tf"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if most:
        terms = terms.orderBy(F.desc("total"), "term").limit(most)
    n = tf.agg(F.count_distinct("group").alias("n"))
    w = tf.join(terms.drop("total"), "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    norms = w.groupBy("group").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, "group").select(F.col("group").alias(group), "term", "tf", "df", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_cosine(weights: DataFrame, group: str) -> DataFrame:
    """(group_a, group_b, cosine) of all group pairs, by one join on the term."""
    a = weights.select(F.col(group).alias("group_a"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col(group).alias("group_b"), "term", F.col("weight").alias("wb"))
    return a.join(b, "term").filter("group_a < group_b").groupBy("group_a", "group_b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 4).alias("cosine"))


def top_terms(weights: DataFrame, group: str, k: int = 20) -> DataFrame:
    """The k heaviest terms of each group, by term on ties, with their rank."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))
    return weights.filter("weight > 0").withColumn("rank", r).filter(F.col("rank") <= k).select(group, "rank", "term", F.round("weight", 4).alias("weight"))


def unigrams_bigrams(words: Column) -> Column:
    """Words, and pairs of neighbouring words joined by a blank."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def self_bleu(df: DataFrame, id_col: str, group: str, tokens: Column) -> DataFrame:
    """(group, n, self_bleu): mean unigram self-BLEU. A document's clipped counts use the element-wise maximum over the other documents of
    its group, which is the largest or, for its sole holder, the second largest count of the token: linear instead of all pairs."""
    d = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), tokens.alias("t")).withColumn("len", F.size("t"))
    c = d.select("g", "id", F.explode("t").alias("w")).groupBy("g", "w", "id").agg(F.count("*").alias("c"))
    per = c.groupBy("g", "w", "c").agg(F.count("*").alias("holders"))
    top = per.groupBy("g", "w").agg(F.max(F.struct("c", "holders")).alias("m"), F.max("c").alias("c1"))
    second = per.join(top.select("g", "w", "c1"), ["g", "w"]).filter(F.col("c") < F.col("c1")).groupBy("g", "w").agg(F.max("c").alias("c2"))
    best = top.join(second, ["g", "w"], "left").select("g", "w", "c1", F.col("m.holders").alias("holders"), F.coalesce("c2", F.lit(0)).alias("c2"))
    limit = F.when((F.col("c") == F.col("c1")) & (F.col("holders") == 1), F.col("c2")).otherwise(F.col("c1"))
    clipped = c.join(best, ["g", "w"]).groupBy("g", "id").agg(F.sum(F.least(F.col("c"), limit)).alias("hit"))
    # closest reference length among the other documents: the distinct lengths of a group with their holders
    lens = d.groupBy("g", "len").agg(F.count("*").alias("k"))
    w = Window.partitionBy("g").orderBy("len")
    near = lens.withColumns({"below": F.lag("len").over(w), "above": F.lead("len").over(w)})
    own = d.select("g", "id", "len").join(near, ["g", "len"])
    below, above = F.col("len") - F.col("below"), F.col("above") - F.col("len")
    ref = F.when(F.col("k") > 1, F.col("len")).otherwise(F.when(below.isNull(), F.col("above")).when(above.isNull() | (below <= above), F.col("below")).otherwise(F.col("above")))
    own = own.withColumn("ref", ref)
    bp = F.when(F.col("len") >= F.col("ref"), 1.0).otherwise(F.exp(1.0 - F.try_divide(F.col("ref"), F.col("len"))))
    j = own.join(clipped, ["g", "id"], "left")
    score = F.when((F.col("len") > 0) & F.col("ref").isNotNull(), F.round(F.coalesce(F.col("hit"), F.lit(0)) / F.col("len") * bp, 4))
    return j.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("self_bleu")).withColumnRenamed("g", group)


def numbered_tokens(t: DataFrame, parts: int | None = None) -> DataFrame:
    """(g, pos, w): the tokens of each group's texts read one after the other in id order, with their place from 0. t: g, id, t.

    Texts are sorted over ranges of (g, id); places are prefix sums over ranges and inside them, so no task reads a whole group."""
    spark = t.sparkSession
    parts = parts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = durable(t.filter(F.size("t") > 0).repartitionByRange(parts, "g", "id").withColumn("_p", F.spark_partition_id()))
    size = F.size("t").cast("bigint")
    base = src.groupBy("g", "_p").agg(F.sum(size).alias("_c"))
    base = base.withColumn("_off", F.coalesce(F.sum("_c").over(Window.partitionBy("g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("g", "_p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = null_safe(src.withColumn("_in", inside), base, ["g", "_p"])
    return j.select("g", (F.col("_off") + F.col("_in")).alias("_at"), F.posexplode("t").alias("_i", "w")).select("g", (F.col("_at") + F.col("_i")).alias("pos"), "w")


def corpus_mattr(tokens: DataFrame, window: int = 50, chunk: int = 20_000) -> DataFrame:
    """(g, mattr): moving-average type-token ratio over numbered tokens; the plain ratio for groups shorter than the window.

    Tokens go to chunks of their place; the first window - 1 tokens of a chunk also go to the chunk before it, so that every window
    lies in one chunk. A task holds a chunk, never a group."""
    k = F.floor(F.col("pos") / chunk)
    tail = (F.col("pos") % chunk < window - 1) & (k > 0)
    placed = tokens.withColumn("_k", F.explode(F.when(tail, F.array(k, k - 1)).otherwise(F.array(k))))

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        w = f.sort_values("pos")["w"].tolist()
        own = int((f["pos"] // chunk == key[1]).sum())
        count: dict = {}
        total = wins = 0
        for i, x in enumerate(w):
            count[x] = count.get(x, 0) + 1
            if i >= window:
                y = w[i - window]
                count[y] -= 1
                if not count[y]:
                    del count[y]
            if i >= window - 1:
                total, wins = total + len(count), wins + 1
        return pd.DataFrame([[key[0], own, total, wins, len(set(w))]], columns=["g", "own", "total", "wins", "types"])

    kind = tokens.schema["g"].dataType.simpleString()
    parts = placed.groupBy("g", "_k").applyInPandas(one, f"g {kind}, own bigint, total bigint, wins bigint, types bigint")
    s = parts.groupBy("g").agg(F.sum("own").alias("n"), F.sum("total").alias("total"), F.sum("wins").alias("wins"), F.max("types").alias("types"))
    return s.select("g", F.when(F.col("n") < window, F.col("types") / F.col("n")).otherwise(F.col("total") / F.col("wins") / window).alias("mattr"))


def lexical_diversity(df: DataFrame, id_col: str, group: str, tokens: Column, window: int = 50) -> DataFrame:
    """(group, n, corpus_ttr, corpus_mattr, corpus_mtld): diversity of a group's texts read one after the other in id order.

    MATTR is counted over chunks of the tokens. MTLD is sequential by definition: where a factor begins depends on all tokens before it,
    so a group's tokens are streamed through one task per direction in id order, with the types of the open factor as the only state."""
    t = durable(df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), tokens.alias("t")))
    ttr = t.select("g", F.explode("t").alias("w")).groupBy("g", "w").agg(F.count("*").alias("c")).groupBy("g").agg(F.count("*").alias("types"), F.sum("c").alias("tokens"))
    n = t.groupBy("g").agg(F.count("*").alias("n"))
    kind = t.schema["g"].dataType.simpleString()

    def scan(batches):
        """Factors of the streams of a partition, in the order they come: a factor ends where its type-token ratio falls to 0.72."""
        open_: dict = {}  # stream -> tokens, full factors, types and tokens of the open one
        for b in batches:
            for g, rev, toks in zip(b["g"], b["rev"], b["t"]):
                n, full, seen, k = open_.get((g, rev), (0, 0.0, set(), 0))
                for w in reversed(toks) if rev else toks:
                    seen.add(w)
                    k += 1
                    if len(seen) <= 0.72 * k:
                        full, seen, k = full + 1, set(), 0
                open_[g, rev] = n + len(toks), full, seen, k
        rows = []
        for (g, rev), (n, full, seen, k) in open_.items():
            rest = (1 - len(seen) / k) / 0.28 if k else 0.0
            rows.append((g, None if n < 10 else n / (full + rest) if full + rest else float(n)))
        yield pd.DataFrame(rows, columns=["g", "mtld"])

    both = t.withColumn("rev", F.lit(False)).unionByName(t.withColumn("rev", F.lit(True)))
    keyed = both.withColumn("_o", F.when(F.col("rev"), -F.col("id")).otherwise(F.col("id")))
    seq = keyed.repartition("g", "rev").sortWithinPartitions("g", "rev", "_o").select("g", "rev", "t").mapInPandas(scan, f"g {kind}, mtld double")
    m = seq.groupBy("g").agg(F.avg("mtld").alias("mtld")).join(corpus_mattr(numbered_tokens(t), window), "g", "left")
    out = n.join(ttr, "g", "left").join(m, "g", "left")
    plain = F.coalesce(F.try_divide(F.col("types"), F.col("tokens")), F.lit(0.0))
    return out.select(F.col("g").alias(group), "n", F.round(plain, 4).alias("corpus_ttr"), F.round(F.coalesce("mattr", plain), 4).alias("corpus_mattr"), F.round("mtld", 3).alias("corpus_mtld"))


def intra_cosine(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, cosine_mean): mean cosine of all pairs of a group by the closed form on unit vectors, no pairs formed."""
    u = df.select(F.col(group).alias("g"), V.unit(F.col(vector)).alias("u")).filter("u is not null")
    sums = u.select("g", F.posexplode("u").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    return out.select(F.col("g").alias(group), "n", F.when(F.col("n") > 1, F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 4)).alias("cosine_mean"))


def centroid_cosine(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group_a, group_b, cosine) of the groups' mean vectors."""
    m = df.select(F.col(group).alias("g"), F.posexplode(vector).alias("i", "x")).groupBy("g", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = m.groupBy("g").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    a = m.join(norms, "g").select(F.col("g").alias("group_a"), "i", F.col("m").alias("ma"), F.col("norm").alias("na"))
    b = m.join(norms, "g").select(F.col("g").alias("group_b"), "i", F.col("m").alias("mb"), F.col("norm").alias("nb"))
    j = a.join(b, "i").filter("group_a < group_b")
    return j.groupBy("group_a", "group_b").agg(F.sum(F.col("ma") * F.col("mb")).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb")).select("group_a", "group_b", F.round(F.col("d") / (F.col("na") * F.col("nb")), 4).alias("cosine"))


def directions(slices: int, dim: int, seed: int = 42) -> np.ndarray:
    """Random unit directions, the same for a seed."""
    g = np.random.default_rng(seed).normal(size=(slices, dim))
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def sliced_wasserstein(df: DataFrame, group: str, vector: str, dirs: np.ndarray, width: float = 0.001) -> DataFrame:
    """(group_a, group_b, wasserstein): mean over the directions of the distance of one-dimensional projections.

    Projections are counted in bins of the given width per group and direction, before the shuffle; the distance is the area between
    two distribution functions over the bins. It differs from the exact one by less than the width. No task holds a group's projections."""
    d = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(x)) for x in row]).alias("d")) for i, row in enumerate(dirs)])
    p = df.select(F.col(group).alias("g"), F.col(vector).alias("v")).withColumn("_d", F.explode(d)).select("g", F.col("_d.i").alias("i"), F.floor(V.dot(F.col("v"), F.col("_d.d")) / width).alias("bin")).filter("bin is not null")
    h = p.groupBy("g", "i", "bin").agg(F.count("*").alias("c"))
    n = h.groupBy("g", "i").agg(F.sum("c").alias("n"))
    share = h.join(n, ["g", "i"]).select("g", "i", "bin", (F.col("c") / F.col("n")).alias("s"))
    groups = n.select("g").distinct()
    ab = groups.select(F.col("g").alias("group_a")).join(groups.select(F.col("g").alias("group_b")), F.col("group_a") < F.col("group_b"))  # pairs of groups
    rows = share.join(ab, (F.col("g") == F.col("group_a")) | (F.col("g") == F.col("group_b"))).select("group_a", "group_b", "i", "bin", F.when(F.col("g") == F.col("group_a"), F.col("s")).otherwise(-F.col("s")).alias("s"))
    step = rows.groupBy("group_a", "group_b", "i", "bin").agg(F.sum("s").alias("s"))
    w = Window.partitionBy("group_a", "group_b", "i").orderBy("bin")  # bins, not rows: bounded by the range over the width
    area = step.select("group_a", "group_b", "i", (F.abs(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))) * (F.coalesce(F.lead("bin").over(w), F.col("bin")) - F.col("bin"))).alias("a"))
    return area.groupBy("group_a", "group_b", "i").agg((F.sum("a") * width).alias("d")).groupBy("group_a", "group_b").agg(F.round(F.avg("d"), 4).alias("wasserstein"))


def mean_jaccard(df: DataFrame, group: str, tokens: Column, block: int = 2048) -> DataFrame:
    """(group, n, jaccard_mean): mean Jaccard similarity of the token sets of all row pairs of a group; two empty sets count 1. n counts
    the pairs; those with a null set have no similarity. Groups of one row and null groups have no pairs.

    Equal sets are combined with their counts. The distinct sets of a group fall into blocks by hash, and each pair of blocks is one
    task's matrix of intersections: the work is quadratic in the distinct sets of a group, no pair of rows is ever a row. Tokens must
    not hold blanks."""
    x = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.array_join(F.array_sort(F.array_distinct(tokens)), " ").alias("_w"))
    sets = x.groupBy("group", "_w").agg(F.count("*").alias("_c"))
    known = F.when(F.col("_w").isNotNull(), F.col("_c"))
    totals = sets.groupBy("group").agg(F.sum("_c").alias("_n"), F.coalesce(F.sum(known), F.lit(0)).alias("_k"), F.ceil(F.count("_w") / block).cast("int").alias("_b"))
    placed = sets.filter("_w is not null").join(totals.select("group", "_b"), "group").withColumn("_i", F.expr("cast(pmod(xxhash64(_w), _b) as int)"))
    copies = placed.withColumn("_j", F.explode(F.expr("sequence(0, _b - 1)"))).select("group", F.least("_i", "_j").alias("_x"), F.greatest("_i", "_j").alias("_y"), "_i", "_w", "_c")

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["_i"] == key[1]], g[g["_i"] == key[2]]
        ca, cb = a["_c"].to_numpy(float), b["_c"].to_numpy(float)
        total = ca @ _jaccard(a["_w"], b["_w"]) @ cb if len(a) and len(b) else 0.0
        if key[1] == key[2]:
            total = (total - ca.sum()) / 2  # each pair of rows once, no row with itself
        return pd.DataFrame({"group": [key[0]], "_s": [total]})

    kind = x.schema["group"].dataType.simpleString()
    sums = copies.groupBy("group", "_x", "_y").applyInPandas(one, f"group {kind}, _s double").groupBy("group").agg(F.sum("_s").alias("_s"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    return totals.filter("_n > 1").join(sums, "group", "left").select(F.col("group").alias(group), pairs("_n").cast("bigint").alias("n"), F.try_divide("_s", pairs("_k")).alias("jaccard_mean"))


def _jaccard(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaccard similarities of two lists of sets, each one string of different tokens: frequent tokens by a product of 0/1 matrices, the
    others pair by pair."""
    where = []
    for sets in (a, b):
        at: dict[str, list[int]] = {}
        for i, w in enumerate(sets):
            for t in w.split():
                at.setdefault(t, []).append(i)
        where.append(at)
    size = [np.array([len(w.split()) for w in s], float) for s in (a, b)]
    shared = [t for t in where[0] if t in where[1]]
    dense = [t for t in shared if 200 * len(where[0][t]) * len(where[1][t]) > len(a) * len(b)]
    m = [np.zeros((len(s), len(dense)), np.float32) for s in (a, b)]
    for k, t in enumerate(dense):
        for x, at in zip(m, where):
            x[at[t], k] = 1
    both = (m[0] @ m[1].T).astype(float)
    for t in set(shared).difference(dense):
        both[np.ix_(where[0][t], where[1][t])] += 1
    union = size[0][:, None] + size[1][None, :] - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))
