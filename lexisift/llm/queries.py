"""Queries of the training-data operators over the tables in a folder, and the SQL that some of them can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest, encoding, markup, pairs, repetition, sentences, terms, tokens, truncation
from .common import RESPONSE_FIELDS, answer_values, durable, is_empty, response_values, table

KEYS = ["field", "row_id"]


def _nlq(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paired_examples").select("example_id", "nlq")
    return p.filter(terms.usable_nlq(F.col("nlq")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The leading term of every usable nlq."""
    return terms.leading_terms(_nlq(spark, d), "example_id", "nlq")


def p1_term_scores(spark: SparkSession, d: str) -> DataFrame:
    """All terms of every usable nlq with their scores."""
    return terms.term_scores(_nlq(spark, d), "example_id", "nlq").withColumn("score", F.round("score", 6))


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of ground_truth and nlq_response with their places and posteriors."""
    return sentences.sentences(answer_values(spark, d, ("ground_truth", "nlq_response")), KEYS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_sentences(spark, d).select("field", "row_id", "sent_end")


def p3_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated content of every response value, with the verdict on its host."""
    return repetition.repetition(response_values(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Response values that repeat themselves, by their own share and, near the threshold, by the verdict on their host."""
    return p3_repetition(spark, d).filter("degenerate").select("resp_id", "field")


def _broken(spark: SparkSession, d: str, fields) -> DataFrame:
    values = answer_values(spark, d, fields)
    real = values.filter(~is_empty(F.col("value"))).select(*KEYS, "model", "value")
    limits = truncation.token_limits(table(spark, d, "inference_metrics"), table(spark, d, "model_config")).withColumnRenamed("resp_id", "row_id")
    questions = table(spark, d, "raw_qa").select(F.col("question").alias("value"))
    return truncation.broken_off(real, KEYS, ["model", "field"], limits, more=questions)


def p4_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every response value that is not empty."""
    return _broken(spark, d, RESPONSE_FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_truncated(spark, d).filter("truncated").select(F.col("row_id").alias("resp_id"), "field")


def p4_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of broken values by model and field."""
    return truncation.source_rates(p4_truncated(spark, d), ["model", "field"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Published quartiles and medians that the values refute."""
    return digest.wrong_figures(table(spark, d, "sparql_features"), table(spark, d, "scalar_summary"))


def p5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles and medians from the merged daily digests, with certified rank errors."""
    keys = ["release_tag", "dkey", "metric"]
    return digest.quantiles_from(digest.merge_digests(digest.daily_digests(table(spark, d, "sparql_features")), keys), keys)


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text and kinds of markup of the response values that carry any."""
    return markup.extract(response_values(spark, d), ["resp_id", "field"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup of every response value that carries any: those of the winning container paths of its host (model)."""
    return markup.kinds_found(response_values(spark, d), ["resp_id", "field"]).select("resp_id", "field", F.explode("kinds").alias("kind"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Defect and tag coverage of every pair with a question."""
    fields = ("ground_truth", *RESPONSE_FIELDS)
    cut = _broken(spark, d, fields).filter("truncated").select(*KEYS, "truncated")
    return pairs.defects(answer_values(spark, d, fields), cut, KEYS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pairs(spark, d).filter("defect is not null").select("field", "row_id", "defect")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k; the empty list for null and empty texts."""
    return tokens.token_ids(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or of its pieces if it is longer than a container."""
    return tokens.containers(tokens.token_counts(table(spark, d, "documents")))


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their restored text."""
    return encoding.repaired(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_term_scores, p2_found, p2_sentences, p3_found, p3_repetition, p4_found, p4_truncated, p4_source_rates, p5_found, p5_quantiles, p6_found, p6_clean, p7_found, p7_pairs, p8_ids, p9_containers, p10_found, p10_repaired)}

_TF = """
usable AS (SELECT example_id, nlq FROM paired_examples WHERE nlq IS NOT NULL AND lower(trim(regexp_replace(nlq, '[\\s\\p{Z}]+', ' ', 'g'))) NOT IN ('', 'nan') AND NOT starts_with(trim(regexp_replace(nlq, '[\\s\\p{Z}]+', ' ', 'g')), '[Auto-inferred]')),
tok AS (SELECT example_id, unnest(regexp_extract_all(lower(nlq), '[\\p{L}\\p{N}]+')) AS term FROM usable),
tf AS (SELECT example_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT example_id, term, tf, df, (0.1 + ln(tf)) * ln((1.0 + (SELECT count(*) FROM usable)) / (1.0 + df)) AS w FROM tf JOIN df USING (term)),
s AS (SELECT example_id, term, tf, df, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY example_id)), 0), 0.0) AS score FROM w)
"""

ORACLE = {
    "p1_found": f"WITH {_TF}, r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY w DESC, term) AS k FROM w) SELECT example_id, term FROM r WHERE k = 1",
    "p1_term_scores": f"WITH {_TF} SELECT example_id, term, tf, df, round(score, 6) AS score FROM s",
    "p5_found": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY ingested_at DESC, release_tag DESC, domain DESC) AS k FROM sparql_features),
v AS (SELECT release_tag, lower(trim(domain)) AS dkey, complexity_score, compositional_score, CAST(char_count AS DOUBLE) AS char_count FROM r WHERE k = 1),
l AS (SELECT release_tag, dkey, metric, x FROM (UNPIVOT v ON complexity_score, compositional_score, char_count INTO NAME metric VALUE x) WHERE x IS NOT NULL AND isfinite(x)),
c AS (SELECT s.release_tag, s.metric, s.domain, count(*) AS n,
  count(*) FILTER (x < p25) AS b1, count(*) FILTER (x <= p25) AS u1, count(*) FILTER (x < median) AS b2, count(*) FILTER (x <= median) AS u2, count(*) FILTER (x < p75) AS b3, count(*) FILTER (x <= p75) AS u3
  FROM scalar_summary s JOIN l ON l.release_tag = s.release_tag AND l.metric = s.metric AND l.dkey = lower(trim(s.domain)) GROUP BY ALL)
SELECT DISTINCT release_tag, metric, domain FROM c WHERE b1 / n > 0.25 + 0.05 OR u1 / n < 0.25 - 0.05 OR b2 / n > 0.5 + 0.05 OR u2 / n < 0.5 - 0.05 OR b3 / n > 0.75 + 0.05 OR u3 / n < 0.75 - 0.05
""",
}
