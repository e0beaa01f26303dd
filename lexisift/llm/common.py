"""Shared pieces of the training-data operators: table readers and the predicate for empty values."""

from __future__ import annotations

import functools

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, spec, spread  # noqa: F401

RESPONSE_FIELDS = ("nlq_response", "nlq_cot_response", "sparql_response", "sparql_cot_response")

# Spellings that stand for a missing answer, words of a bare answer tag, heads of failure notices.
MISSING_MARKERS = (
    "nan", "none", "null", "nil", "n/a", "n.a.", "na", "nd", "<na>", "#n/a", "undefined", "missing", "empty", "blank", "[empty]", "[none]",
    "[missing]", "[blank]", "[null]", "(empty)", "(none)", "(blank)", "<empty>", "<none>", "<null>", "no answer", "no response", "[no answer]", "[no response]", "not available", "tbd", "todo", "k. a.", "s/o",
)
ANSWER_TAGS = (
    "final answer", "short answer", "answer", "response", "reply", "a", "antwort", "réponse", "respuesta", "resposta", "ответ", "答案", "回答", "答え", "答", "คำตอบ", "उत्तर",
)
FAILURE_HEADS = ("error", "degenerate_output", "failed", "exception", "traceback", "timeout", "timed out", "cuda out of memory", "runtimeerror", "[error", "<error", "generation failed", "inference failed")

#: White space, controls and format characters (zero width, bidi marks, soft hyphen, BOM, fillers, variation selectors).
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{FE00}-\x{FE0F}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alt(words) -> str:
    return "|".join("\\Q" + w + "\\E" for w in sorted(words, key=len, reverse=True))


def visible(col: Column) -> Column:
    """The value without invisible characters at its ends, inner runs of them as one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), INVISIBLE + "+", " ")))


def _words(phrases) -> str:
    """Alternation of literal phrases, any invisible run between their words."""
    return "|".join((INVISIBLE + "+").join("\\Q" + w + "\\E" for w in p.split()) for p in sorted(phrases, key=len, reverse=True))


_LETTER = r"[\p{L}\p{M}\p{N}]"
#: More letters and digits than any marker or tag has: at least so many stand in the text. Anchored and possessive, so it reads no further.
_SAYS_MORE = r"^(?:[^\p{L}\p{M}\p{N}]*+" + _LETTER + "){" + str(1 + max(len(regex.sub(r"[^\p{L}\p{M}\p{N}]", "", w)) for w in (*MISSING_MARKERS, *ANSWER_TAGS))) + "}"
_FAILED = r"^(?i)" + INVISIBLE + r"*+[\[\(<]?(?:" + _words(h.lstrip("[<") for h in FAILURE_HEADS) + r")(?:" + INVISIBLE + r"*[:\]\)>]|" + INVISIBLE + r"+(?:processing|while|during|in|at|code|after|occurred)\b|" + INVISIBLE + r"*\z)"
_NOTHING = (
    r"^(?:[\p{P}\p{S}\s]*+|" + _alt(MISSING_MARKERS)
    + r"|[\p{P}\p{S}\s]*(?:" + _alt(ANSWER_TAGS) + r")[*_\s]*[:：][\p{P}\p{S}\s]*|(?:#+\s*|\*\*|<)(?:" + _alt(ANSWER_TAGS) + r")[\p{P}\p{S}\s]*)$"
)


def is_empty(col: Column) -> Column:
    """True for null, blank or invisible-only values, markers of a missing value, bare answer tags and notices of a failed or degenerate run.

    Holds for values of any length. Most values are settled by their first letters: they have more of them than any marker or tag."""
    short = F.when(col.rlike(_SAYS_MORE), False).otherwise(visible(col).rlike(_NOTHING))
    return F.coalesce(short | col.rlike(_FAILED), F.lit(True))


def response_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per response value: resp_id, model (empty if null), query_id, question, field, value. Null values stay."""
    r = table(spark, sf_dir, "all_models_responses")
    return r.select("resp_id", F.coalesce("model", F.lit("")).alias("model"), "query_id", "question", *RESPONSE_FIELDS).unpivot(
        ["resp_id", "model", "query_id", "question"], list(RESPONSE_FIELDS), "field", "value"
    )


def answer_values(spark: SparkSession, sf_dir: str, fields=("ground_truth", *RESPONSE_FIELDS)) -> DataFrame:
    """ground_truth of raw_qa and response fields in one long table: field, row_id, model (raw_qa for ground_truth), question, value."""
    parts = []
    wide = [f for f in fields if f != "ground_truth"]
    if wide:
        r = table(spark, sf_dir, "all_models_responses").select("resp_id", F.coalesce("model", F.lit("")).alias("model"), "question", *wide)
        parts.append(r.unpivot(["resp_id", "model", "question"], wide, "field", "value").select("field", F.col("resp_id").alias("row_id"), "model", "question", "value"))
    if "ground_truth" in fields:
        q = table(spark, sf_dir, "raw_qa")
        parts.append(q.select(F.lit("ground_truth").alias("field"), F.col("qa_id").alias("row_id"), F.lit("raw_qa").alias("model"), "question", F.col("ground_truth").alias("value")))
    return functools.reduce(DataFrame.unionByName, parts)
