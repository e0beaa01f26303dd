"""Features of natural-language questions and responses."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Question types with their anchors in order, stop words, clause markers and flag patterns.
QUESTION_TYPES = (
    ("Who", r"who\b"), ("What", r"what\b"), ("Which", r"which\b"), ("When", r"when\b"), ("Where", r"where\b"), ("Why", r"why\b"),
    ("How_many", r"how\s+many\b"), ("How_much", r"how\s+much\b"), ("How", r"how\b"), ("Is_Are", r"(?:is|are|was|were)\b"), ("Do_Does_Did", r"(?:do|does|did)\b"),
    ("Can_Could", r"(?:can|could|may|might|shall|should|will|would)\b"), ("List", r"(?:list|give|show|find|return|retrieve)\b"),
)
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could of in on at to for with by from and or but if as that this these those it its "
    "what which who when where why how all any both each few more most other some such no nor not only same so than too very just also about after"
).split()
CLAUSE_MARKERS = "which that who whom whose where when because although since unless whether if as while whereas after before until once".split()
FLAGS = {
    "has_comparative": r"\b(?:more|less|fewer|higher|lower|greater|older|newer|better|worse|most|least|highest|lowest|greatest|oldest|newest|best|worst)\b",
    "has_negation": r"\b(?:not|no|never|neither|nor|without|except|exclude|n't)\b",
    "has_temporal": r"\b(?:before|after|since|until|during|between|in\s+\d{4}|by\s+\d{4}|as\s+of|current|latest|recent|historical|past|future)\b",
    "has_numeric": r"\b\d+\b",
    "has_aggregation": r"\b(?:how\s+many|how\s+much|total|sum|average|mean|count|number\s+of|percentage|proportion|rate|most|least|maximum|minimum|highest|lowest)\b",
}
SURFACE = ("char_len", "word_count", "type_count", "ttr", "content_ratio", "avg_word_len", "clause_count", "question_type", *FLAGS, "has_question_mark")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def question_type(c: Column) -> Column:
    t = F.lower(trimmed(c))
    out = F.when(t.rlike("^" + QUESTION_TYPES[0][1]), QUESTION_TYPES[0][0])
    for name, p in QUESTION_TYPES[1:]:
        out = out.when(t.rlike("^" + p), name)
    return F.when(t.isNotNull(), out.otherwise("Other"))


def words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0)), lambda w: w.rlike("^[a-z]"))


def surface_features(df: DataFrame, text: str) -> DataFrame:
    """df with surface features of a text column; null text gives nulls, text without words zeros."""
    df = df.withColumn("_t", trimmed(F.col(text)))
    df = df.withColumn("_w", words(F.col("_t")))
    n = F.size("_w")
    ratio = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    low = F.lower("_t")
    df = df.withColumns(
        {
            "char_len": F.length("_t"),
            "word_count": n,
            "type_count": F.size(F.array_distinct("_w")),
            "ttr": F.round(ratio(F.size(F.array_distinct("_w"))), 4),
            "content_ratio": F.round(ratio(F.size(F.filter("_w", lambda w: ~w.isin(*STOP_WORDS)))), 4),
            "avg_word_len": F.round(ratio(F.aggregate("_w", F.lit(0), lambda s, w: s + F.length(w))), 3),
            "clause_count": F.regexp_count(low, F.lit(r"\b(?:" + "|".join(CLAUSE_MARKERS) + r")\b")),
            "question_type": question_type(F.col("_t")),
            **{k: low.rlike(p).cast("int") for k, p in FLAGS.items()},
            "has_question_mark": F.endswith("_t", F.lit("?")).cast("int"),
        }
    )
    return df.drop("_t", "_w")


def readability(df: DataFrame, text: str) -> DataFrame:
    """Flesch ease, Flesch-Kincaid grade, Gunning fog and SMOG from counts of sentences, words and groups of vowels.

    Syllables are groups of vowels, at least one a word, less a silent final e; dictionaries are not used."""
    df = df.withColumn("_w", words(F.col(text)))
    syll = lambda w: F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "(?<=[^aeiouy])e$", ""), F.lit("[aeiouy]+")))
    df = df.withColumn("_s", F.transform("_w", syll)).withColumn("_n", F.size("_w"))
    sents = F.greatest(F.lit(1), F.regexp_count(F.col(text), F.lit(r"[.!?]+(?:\s|$)")))
    syllables = F.aggregate("_s", F.lit(0), lambda a, x: a + x)
    hard = F.size(F.filter("_s", lambda x: x >= 3))
    n = F.col("_n")
    wps, spw = n / sents, syllables / n
    out = {
        "flesch_ease": 206.835 - 1.015 * wps - 84.6 * spw,
        "fk_grade": 0.39 * wps + 11.8 * spw - 15.59,
        "gunning_fog": 0.4 * (wps + 100.0 * hard / n),
        "smog": 1.043 * F.sqrt(hard * (30.0 / sents)) + 3.1291,
    }
    return df.withColumns({k: F.when(n > 0, F.round(v, 2)) for k, v in out.items()}).drop("_w", "_s", "_n")


@F.pandas_udf(StringType())
def normalised(c: pd.Series) -> pd.Series:
    """Text in compatibility form (NFKC), white space other than blanks, tabs and line ends as one blank, controls gone, trimmed; [EMPTY] for null
    and blank texts."""
    def one(t):
        if t is None or not t.strip():
            return "[EMPTY]"
        t = re.sub(r"[^\S\n\t ]+", " ", unicodedata.normalize("NFKC", t))
        return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t).strip()

    return c.map(one)


def sentence_split(c: Column) -> Column:
    """Pieces after final marks followed by white space, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def clean_response(c: Column) -> Column:
    """Text after the last answer tag, without leading signs that are no letters, digits or opening parentheses."""
    t = F.regexp_replace(c, r"(?is)^.*answer\s*[*]*\s*:", "")
    return trimmed(F.regexp_replace(t, r"^[^\p{L}\p{N}_(]+", ""))


def claims(c: Column, least: int = 5) -> Column:
    """Sentences of at least so many words separated by white space."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), trimmed)
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least)


def repeated_line(c: Column, most: int = 10) -> Column:
    """A line that comes more than most times in a text of more than most lines, or null."""
    lines = F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")
    often = F.filter(F.array_distinct(lines), lambda x: F.size(F.filter(lines, lambda y: y == x)) > most)
    return F.when(F.size(F.split(c, "\n")) > most, F.try_element_at(often, F.lit(1)))


def repeated_word(c: Column, most: int = 10) -> Column:
    """A word said more than most times in a row, or null."""
    found = F.regexp_extract(c, rf"(?:^|\s)(\S+)(?:\s+\1){{{most},}}(?=\s|$)", 1)
    return F.when(found != "", found)


def degenerate(c: Column, lines: int = 10, words: int = 10) -> Column:
    """'line', 'word' or null: the kind of degenerate repetition, beyond so many lines or words."""
    return F.when(repeated_line(c, lines).isNotNull(), "line").when(repeated_word(c, words).isNotNull(), "word")


def word_total(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))).otherwise(0)


def density(typed: Column, c: Column) -> Column:
    """Typed triples per word of a text, four decimals, 0 without words."""
    return F.round(F.coalesce(F.try_divide(typed, word_total(c)), F.lit(0.0)), 4)


def mattr(tokens: Column, window: int = 50) -> Column:
    """Moving-average type-token ratio; the plain ratio for texts shorter than the window, 0 for empty ones."""
    n = F.size(tokens)
    plain = F.coalesce(F.try_divide(F.size(F.array_distinct(tokens)), n), F.lit(0.0))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1)), lambda i: F.size(F.array_distinct(F.slice(tokens, i, window))))
    moving = F.aggregate(spans, F.lit(0.0), lambda s, x: s + x) / (n - window + 1) / window
    return F.when(n < window, plain).otherwise(moving)
