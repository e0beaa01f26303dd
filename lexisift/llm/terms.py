"""Problem 1: how distinctive a term is for its record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a single mention; every further mention adds logarithmically, so a term must come back to lead its record.
SINGLE = 0.1


def terms_of(text: Column) -> Column:
    """Maximal runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def usable_nlq(col: Column) -> Column:
    """Neither missing (null, blank, nan) nor a generated stand-in."""
    t = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s\p{Z}]+", " "))
    return (t != "") & (F.lower(t) != "nan") & ~F.startswith(t, F.lit("[Auto-inferred]"))


def term_scores(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, df, score): score = (SINGLE + ln tf) * ln((1 + N) / (1 + df)), divided by the Euclidean length of the record's scores.

    N counts the given records, also those without terms. Counts are combined per partition before each shuffle; document
    frequencies come from the distinct (record, term) counts and are joined back, never collected. Records of null or empty
    text give no row. The same text under two ids counts twice. An id must be unique.
    """
    src = records.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = src.agg(F.count("*").alias("n"))
    tf = src.select("id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads the same columns, so the counts are shuffled once
    weight = (F.lit(SINGLE) + F.log("tf")) * F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("w", weight)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return scored.withColumn("score", F.coalesce(F.try_divide(F.col("w"), norm), F.lit(0.0))).select(F.col("id").alias(id_col), "term", "tf", "df", "score")


def leading_terms(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): the term with the highest score of each record; of equal scores the first term in code-point order."""
    s = term_scores(records, id_col, text_col)
    return s.groupBy(id_col).agg(F.min_by("term", F.struct(-F.col("score"), F.col("term"))).alias("term"))
