"""Queries over the tables in a folder, one per operator, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formal, questions, values, vectors
from ..functions.stats import normal_tail_sql
from ..operators import algebra, corpus, harness, latent, pairing, profiles, stats, triples
from ..session import durable, spread
from ..sources import sinks, tables
from .rules import SURFACES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- inputs -------------------------------------------------------------------------------------------------------------------

METRIC_NAMES = ["complexity_score", "nary_count", "compositional_score", "operator_count", "operator_diversity", "join_count", "nesting_depth", "entity_count", "class_count", "relation_count", "literal_count", "namespace_count", "ttr", "vocab_tokens", "line_count", "token_count", "char_count"]
SURFACE_NAMES = ["char_len", "word_count", "type_count", "ttr", "content_ratio", "avg_word_len", "clause_count"]
LATENT = ["seconds", "confidence", "prompt_len", "answer_len", "rate"]


def formal_corpus(spark, d) -> DataFrame:
    p = read(spark, d, "paired_examples").select("example_id", "domain", "nlq", "sparql")
    return formal.query_features(spread(p.filter(F.length(F.trim("sparql")) > 10)), "sparql")


def formal_once(spark, d) -> DataFrame:
    """The featurised queries as a table, for operators that read them more than once: the features cost more than the table."""
    f = formal_corpus(spark, d)
    return durable(f.select("example_id", "domain", "query_form", *METRIC_NAMES, "has_negation", *[c for c in f.columns if c.startswith("op_")]))


def question_once(spark, d) -> DataFrame:
    return durable(question_corpus(spark, d).select("domain", *SURFACE_NAMES))


def question_corpus(spark, d) -> DataFrame:
    p = tables.corpus(read(spark, d, "paired_examples").select("example_id", "domain", "nlq"), "nlq", 3)
    return questions.surface_features(spread(p), "text")


def long_metrics(spark, d) -> DataFrame:
    """(model, domain, method, query_id, resp_id, time and the metrics) of the rows with a known method."""
    r = read(spark, d, "all_models_responses").select("resp_id", "domain")
    m = read(spark, d, "inference_metrics").withColumn("method", values.method_name("query_mode")).filter(F.col("method").isin(*values.METHODS))
    return m.join(r, "resp_id").select(
        "resp_id", "model", "domain", "method", "query_id", F.col("processing_timestamp").alias("at"), F.col("generation_time_seconds").alias("kd"), F.col("confidence_score").alias("recall"),
        F.try_divide(F.col("generated_length").cast("double"), F.col("input_length").cast("double")).alias("claim_recall"), "input_length", "generated_length",
    )


def latent_rows(spark, d) -> DataFrame:
    m = long_metrics(spark, d).select("model", "domain", "method", "query_id", "at", F.col("kd").alias("seconds"), F.col("recall").alias("confidence"), F.col("input_length").cast("double").alias("prompt_len"), F.col("generated_length").cast("double").alias("answer_len"), F.col("claim_recall").alias("rate"))
    m = latent.impute(m, LATENT)
    return m.groupBy("model", "domain", "method", "query_id").agg(*[F.min(F.struct("at", *LATENT)).alias("r")]).select("model", "domain", "method", "query_id", *[F.col(f"r.{c}").alias(c) for c in LATENT])


def answers(spark, d) -> DataFrame:
    """(resp_id, model, domain, method, question, response) in long form."""
    r = read(spark, d, "all_models_responses")
    long = r.select("resp_id", "model", "domain", "query_id", "question", *[F.col(f"{m}_response").alias(m) for m in values.METHODS]).unpivot(["resp_id", "model", "domain", "query_id", "question"], list(values.METHODS), "method", "response")
    return long


_UP = "upper(regexp_replace(sparql, '#[^\\n]*', '', 'g'))"
_BODY = "regexp_replace(sparql, '#[^\\n]*', '', 'g')"


def _n(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INTEGER)"


_OPS = {k: _n("up", p) for k, p in formal.OPERATORS.items()}
_OPS["FILTER"] = f"({_n('up', formal.OPERATORS['FILTER'])} - {_n('up', r'\bFILTER\s+NOT\b')})"
_BOIL = ", ".join(f"'{w}'" for w in formal.BOILERPLATE)
_VARS = ", ".join(f"'{v}'" for v in formal.COMMON_VARIABLES)
FORMAL_SQL = f"""
b AS (SELECT example_id, domain, nlq, sparql, {_BODY} AS body, {_UP} AS up FROM paired_examples WHERE length(trim(sparql)) > 10),
o AS (SELECT *, {", ".join(f'{v} AS "op_{k}"' for k, v in _OPS.items())}, regexp_extract_all(body, '\\?\\w+') AS vars,
  list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(body, 'PREFIX\\s+\\w+:\\s*<[^>]+>', '', 'g'), '<[^>]+>', '', 'g')), '[a-z_]\\w*'), lambda t : t NOT IN ({_BOIL}) AND length(t) > 2) AS toks FROM b),
g AS (SELECT *, CASE WHEN regexp_matches(up, '\\bCONSTRUCT\\b') THEN 'CONSTRUCT' WHEN regexp_matches(up, '\\bDESCRIBE\\b') THEN 'DESCRIBE' WHEN regexp_matches(up, '\\bASK\\b') THEN 'ASK' WHEN regexp_matches(up, '\\bSELECT\\b') THEN 'SELECT' ELSE 'UNKNOWN' END AS query_form,
  {" + ".join(f'"op_{k}" * {w}' for k, w in formal.WEIGHTS.items())} AS complexity_score,
  {_n("body", "_:[a-zA-Z0-9]+\\s+\\w+:(?:hasParticipant|involvesRole)")} + {_n("sparql", "#\\s*n-ary\\s+(?:PRECONDITION_CHAIN|PARTICIPANT_SET|QUANTIFIED_RELATION|TEMPORAL_CONTEXT|SPATIAL_CONTEXT|CONDITIONAL_ROLE)")} + CASE WHEN {_n("up", "FILTER\\s+EXISTS\\s*\\{")} >= 2 THEN 1 ELSE 0 END AS nary_count,
  CAST(regexp_matches(upper(sparql), '\\bFILTER\\s+NOT\\s+EXISTS\\b|\\bMINUS\\b') AS INTEGER) AS has_negation,
  CAST(regexp_matches(sparql, '_:queryMeta\\s+rdf:type|rdfs:comment[^\\n]*@en') AS INTEGER) AS has_annotation,
  {" + ".join(f'"op_{k}"' for k in formal.OPERATORS)} AS operator_count,
  {" + ".join(f'CAST("op_{k}" > 0 AS INTEGER)' for k in formal.OPERATORS)} AS operator_diversity,
  CAST(len(list_filter(list_distinct(vars), lambda v : len(list_filter(vars, lambda x : x = v)) >= 2)) AS INTEGER) AS join_count,
  CAST(greatest(0, coalesce(list_max(list_transform(range(1, length(body) + 1), lambda i : length(regexp_replace(body[1:i], '[^{{]', '', 'g')) - length(regexp_replace(body[1:i], '[^}}]', '', 'g')))), 0)) AS INTEGER) AS nesting_depth,
  CAST(len(list_filter(list_distinct(vars), lambda v : v NOT IN ({_VARS}))) AS INTEGER) AS entity_count,
  {_n("body", "rdf:type\\b")} AS class_count, {_n("body", "(?:broadband|landline|legal|case|fi|property):\\w+\\s+\\?")} AS relation_count, {_n("body", '"[^"]*"')} AS literal_count,
  CAST(len(list_distinct(regexp_extract_all(up, '\\bPREFIX\\s+(\\w+):', 1))) AS INTEGER) AS namespace_count,
  CAST(len(toks) AS INTEGER) AS vocab_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS type_count,
  CAST(len(string_split(regexp_replace(sparql, '^\\s+|\\s+$', '', 'g'), chr(10))) AS INTEGER) AS line_count, {_n("body", "\\S+")} AS token_count, CAST(length(sparql) AS INTEGER) AS char_count FROM o),
f AS (SELECT *, round(coalesce(type_count / nullif(vocab_tokens, 0), 0.0), 4) AS ttr, round(2.0 * operator_diversity + 1.5 * join_count + nesting_depth, 2) AS compositional_score FROM g)
"""
_STOP = ", ".join(f"'{w}'" for w in questions.STOP_WORDS)
QUESTION_SQL = f"""
t AS (SELECT example_id, domain, regexp_replace(nlq, '^\\s+|\\s+$', '', 'g') AS text FROM paired_examples),
w AS (SELECT *, regexp_replace(lower(text), '[^\\x{{00}}-\\x{{7F}}\\p{{P}}\\p{{S}}\\p{{Z}}]', 'x', 'g') AS low, list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x : regexp_matches(x, '^[a-z]')) AS w FROM t WHERE length(text) > 3),
q AS (SELECT example_id, domain, text, w, CAST(length(text) AS INTEGER) AS char_len, CAST(len(w) AS INTEGER) AS word_count, CAST(len(list_distinct(w)) AS INTEGER) AS type_count,
  round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0.0), 4) AS ttr, round(coalesce(len(list_filter(w, lambda x : x NOT IN ({_STOP}))) / nullif(len(w), 0), 0.0), 4) AS content_ratio,
  round(coalesce(CAST(list_sum(list_transform(w, lambda x : length(x))) AS DOUBLE) / nullif(len(w), 0), 0.0), 3) AS avg_word_len,
  {_n("low", r"\b(?:" + "|".join(questions.CLAUSE_MARKERS) + r")\b")} AS clause_count,
  CASE {" ".join(f"WHEN regexp_matches(low, '^{p}') THEN '{n}'" for n, p in questions.QUESTION_TYPES)} ELSE 'Other' END AS question_type,
  {", ".join(f"CAST(regexp_matches(low, '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER) AS {k}" for k, p in questions.FLAGS.items())},
  CAST(ends_with(text, '?') AS INTEGER) AS has_question_mark FROM w)
"""
LONG_SQL = """
m0 AS (SELECT *, regexp_replace(lower(trim(query_mode)), '[^a-z0-9]+', '_', 'g') AS method FROM inference_metrics),
m AS (SELECT i.resp_id, i.model, r.domain, i.method, i.query_id, i.processing_timestamp AS seen_at, i.generation_time_seconds AS kd, i.confidence_score AS recall,
  CAST(generated_length AS DOUBLE) / nullif(CAST(input_length AS DOUBLE), 0) AS claim_recall, input_length, generated_length
  FROM m0 i JOIN all_models_responses r USING (resp_id) WHERE method IN ('nlq', 'nlq_cot', 'sparql', 'sparql_cot'))
"""
_FIN = "CASE WHEN isfinite({0}) THEN {0} END"


# ---- formal query corpus -------------------------------------------------------------------------------------------------------


@query(f"WITH {FORMAL_SQL} SELECT example_id, domain, {', '.join(formal.FEATURES)}, {', '.join(f'"op_{k}"' for k in formal.OPERATORS)} FROM f")
def formal_features(spark, d):
    return formal_corpus(spark, d).select("example_id", "domain", *formal.FEATURES, *[f"op_{k}" for k in formal.OPERATORS])


_FORMS = (*formal.FORMS, "UNKNOWN")


@query(f"WITH {FORMAL_SQL} SELECT domain, count(*) AS n, {', '.join(f"count(*) FILTER (query_form = '{x}') AS n_{x}" for x in _FORMS)}, {', '.join(f"round(100.0 * count(*) FILTER (query_form = '{x}') / count(*), 2) AS pct_{x}" for x in _FORMS)} FROM f GROUP BY domain")
def query_form_distribution(spark, d):
    return profiles.form_distribution(formal_corpus(spark, d))


@query(f"WITH {FORMAL_SQL} " + " UNION ALL ".join(f"SELECT domain, '{k}' AS operator, round(avg(\"op_{k}\"), 3) AS mean, round(100.0 * count(*) FILTER (\"op_{k}\" > 0) / count(*), 1) AS pct_nonzero FROM f GROUP BY domain" for k in formal.OPERATORS))
def operator_profile(spark, d):
    return profiles.operator_profile(formal_corpus(spark, d))


def _summary_sql(cte: str, rel: str, names: list[str]) -> str:
    return f"WITH {cte} " + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, domain, count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(CAST(min({c}) AS DOUBLE), 3) AS min, round(CAST(max({c}) AS DOUBLE), 3) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 3) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 3) AS p75 FROM {rel} GROUP BY domain"
        for c in names
    )


@query(_summary_sql(FORMAL_SQL, "f", METRIC_NAMES))
def scalar_summary(spark, d):
    return profiles.scalar_summary(formal_once(spark, d), METRIC_NAMES)


@query(f"WITH {FORMAL_SQL} SELECT domain, count(*) FILTER (nary_count > 0) AS n_nary, round(100.0 * count(*) FILTER (nary_count > 0) / count(*), 1) AS pct_nary, round(avg(nary_count), 3) AS mean_nary, max(nary_count) AS max_nary FROM f GROUP BY domain")
def nary_summary(spark, d):
    return profiles.nary_summary(formal_corpus(spark, d))


@query(f"WITH {FORMAL_SQL} SELECT domain, round(100.0 * avg(has_negation), 1) AS pct_has_negation, round(100.0 * avg(has_annotation), 1) AS pct_has_annotation FROM f GROUP BY domain")
def boolean_features(spark, d):
    return profiles.boolean_features(formal_corpus(spark, d))


_COMP = ("operator_diversity", "join_count", "nesting_depth", "compositional_score")


@query(f"WITH {FORMAL_SQL} SELECT domain, {', '.join(f'round(avg({c}), 3) AS {c}_mean, round(median(CAST({c} AS DOUBLE)), 3) AS {c}_median, round(stddev_samp({c}), 3) AS {c}_std' for c in _COMP)} FROM f GROUP BY domain")
def compositionality(spark, d):
    return profiles.compositionality(formal_once(spark, d))


_SUB = ("complexity_score", "join_count", "nesting_depth", "operator_count", "compositional_score")


@query(f"WITH {FORMAL_SQL} SELECT domain, query_form, count(*) AS n, {', '.join(f'round(avg({c}), 3) AS {c}_mean, round(median(CAST({c} AS DOUBLE)), 3) AS {c}_median' for c in _SUB)} FROM f GROUP BY domain, query_form HAVING count(*) >= 3")
def subgroup_analysis(spark, d):
    return profiles.subgroups(formal_once(spark, d))


def _pct(c: str, name: str) -> str:
    return f"round(100.0 * count(*) FILTER ({c}) / count(*), 1) AS {name}"


@query(
    f"WITH {FORMAL_SQL} SELECT domain, count(*) AS n_queries, "
    + ", ".join(_pct(f"query_form = '{x}'", f"{x}_pct") for x in formal.FORMS)
    + ", round(avg(complexity_score), 2) AS mean_complexity, round(median(complexity_score), 2) AS median_complexity, round(stddev_samp(complexity_score), 2) AS std_complexity, "
    + ", ".join(_pct(f'"op_{o}" > 0', f"pct_{o}") for o in ("FILTER", "OPTIONAL", "UNION", "FILTER_NOT_EXISTS", "SUBQUERY", "ORDER_BY", "DISTINCT", "GROUP_BY", "COUNT", "LIMIT"))
    + ", "
    + ", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in ("operator_count", "operator_diversity", "join_count", "nesting_depth", "compositional_score", "entity_count", "class_count", "relation_count", "literal_count", "vocab_tokens"))
    + f", round(avg(ttr), 4) AS mean_ttr, {_pct('nary_count > 0', 'pct_nary')} FROM f GROUP BY domain"
)
def domain_profile(spark, d):
    return profiles.domain_profile(formal_once(spark, d))


_LEVELS = (
    "l AS (SELECT f.*, 'Simple' AS level FROM f WHERE complexity_score >= 0 AND complexity_score < 1 UNION ALL SELECT f.*, '1-hop' FROM f WHERE complexity_score >= 1 AND complexity_score < 3 "
    "UNION ALL SELECT f.*, 'Multi-hop' FROM f WHERE complexity_score >= 3 AND complexity_score < 7 UNION ALL SELECT f.*, 'Aggregation' FROM f WHERE \"op_GROUP_BY\" > 0 OR \"op_COUNT\" > 0 UNION ALL SELECT f.*, 'Negation' FROM f WHERE has_negation > 0)"
)


@query(f"WITH {FORMAL_SQL}, {_LEVELS} SELECT domain, level, count(*) AS n, round(avg(complexity_score), 3) AS mean_complexity FROM l GROUP BY domain, level")
def level_strata(spark, d):
    return profiles.levels(formal_corpus(spark, d)).groupBy("domain", "level").agg(F.count("*").alias("n"), F.round(F.avg("complexity_score"), 3).alias("mean_complexity"))


@query(
    f"WITH {FORMAL_SQL}, {_LEVELS}, s AS (SELECT domain, level, median(complexity_score) AS stratum_median, count(*) AS n FROM l GROUP BY ALL), "
    "k AS (SELECT l.domain, l.level, l.example_id, s.stratum_median, abs(l.complexity_score - s.stratum_median) AS distance, s.n, row_number() OVER (PARTITION BY l.domain, l.level ORDER BY abs(l.complexity_score - s.stratum_median), example_id) AS r FROM l JOIN s USING (domain, level)) "
    "SELECT domain, level, example_id, stratum_median, distance, n FROM k WHERE r = 1"
)
def representative_rows(spark, d):
    return profiles.representatives(profiles.levels(formal_once(spark, d)), "example_id")


@query(f"WITH {FORMAL_SQL} SELECT example_id, CASE WHEN nlq IS NULL OR lower(trim(nlq)) IN ('', 'nan', 'none') THEN '[Auto-inferred] ' || query_form || ' query with ' || join_count || ' join(s)' ELSE nlq END AS question FROM f")
def inferred_questions(spark, d):
    f = formal_corpus(spark, d)
    missing = F.col("nlq").isNull() | F.lower(F.trim("nlq")).isin("", "nan", "none")
    return f.select("example_id", F.when(missing, formal.described(F.col("query_form"), F.col("join_count"))).otherwise(F.col("nlq")).alias("question"))


@query(
    "WITH t AS (SELECT row_number() OVER () AS i, domain, list_distinct(regexp_extract_all(lower(sparql), '[a-z_]\\w*')) AS w FROM paired_examples), "
    "p AS (SELECT a.domain, a.w AS v, b.w FROM t a JOIN t b ON a.domain = b.domain AND a.i < b.i) "
    "SELECT domain, count(*) AS n, round(avg(CASE WHEN len(list_distinct(list_concat(v, w))) = 0 THEN 1.0 ELSE len(list_intersect(v, w)) / len(list_distinct(list_concat(v, w))) END), 4) AS jaccard_mean FROM p GROUP BY domain"
)
def jaccard_all_pairs(spark, d):
    """Mean Jaccard similarity of all pairs of queries of a domain."""
    j = corpus.mean_jaccard(read(spark, d, "paired_examples"), "domain", F.regexp_extract_all(F.lower("sparql"), F.lit(r"[a-z_]\w*"), F.lit(0)))
    return j.withColumn("jaccard_mean", F.round("jaccard_mean", 4))


# ---- questions -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {QUESTION_SQL} SELECT example_id, domain, {', '.join(questions.SURFACE)} FROM q")
def surface_features(spark, d):
    return question_corpus(spark, d).select("example_id", "domain", *questions.SURFACE)


@query(f"WITH {QUESTION_SQL} SELECT domain, count(*) AS n, {', '.join(f'round(avg({c}), 3) AS {c}_mean, round(median(CAST({c} AS DOUBLE)), 3) AS {c}_median, round(stddev_samp({c}), 3) AS {c}_std' for c in SURFACE_NAMES)} FROM q GROUP BY domain")
def surface_summary(spark, d):
    return profiles.surface_summary(question_once(spark, d), SURFACE_NAMES)


@query(f"WITH {QUESTION_SQL}, c AS (SELECT domain, question_type, count(*) AS n FROM q GROUP BY ALL) SELECT domain, question_type, n, round(100.0 * n / sum(n) OVER (PARTITION BY domain), 2) AS pct FROM c")
def question_types(spark, d):
    return profiles.type_table(question_corpus(spark, d))


@query()
def readability(spark, d):
    return questions.readability(question_corpus(spark, d).select("example_id", "domain", "text"), "text").drop("text")


@query()
def lexical_diversity(spark, d):
    return corpus.lexical_diversity(question_corpus(spark, d), "example_id", "domain", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)))


@query(
    f"WITH {QUESTION_SQL}, k AS (SELECT example_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM q) SELECT example_id, round(CASE WHEN len(t) < 20 THEN coalesce(len(list_distinct(t)) / nullif(len(t), 0), 0.0) "
    "ELSE list_avg(list_transform(range(1, len(t) - 18), lambda i : CAST(len(list_distinct(t[i:i+19])) AS DOUBLE))) / 20 END, 4) AS mattr FROM k"
)
def question_mattr(spark, d):
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))
    return question_corpus(spark, d).select("example_id", F.round(questions.mattr(t, 20), 4).alias("mattr"))


_BLEU = """
d AS (SELECT domain AS g, example_id AS id, w AS t, len(w) AS len FROM q),
c AS (SELECT g, id, u AS w, count(*) AS c FROM (SELECT g, id, unnest(t) AS u FROM d) GROUP BY ALL),
x AS (SELECT a.g, a.id, a.w, a.c, coalesce((SELECT max(b.c) FROM c b WHERE b.g = a.g AND b.w = a.w AND b.id <> a.id), 0) AS other FROM c a),
h AS (SELECT g, id, sum(least(c, other)) AS hit FROM x GROUP BY ALL),
r AS (SELECT a.g, a.id, a.len, (SELECT b.len FROM d b WHERE b.g = a.g AND b.id <> a.id ORDER BY abs(b.len - a.len), b.len LIMIT 1) AS ref FROM d a)
SELECT r.g AS domain, count(*) AS n, round(avg(CASE WHEN len > 0 AND ref IS NOT NULL THEN round(coalesce(hit, 0) / len * CASE WHEN len >= ref THEN 1.0 ELSE exp(1.0 - ref / len) END, 4) END), 4) AS self_bleu FROM r LEFT JOIN h USING (g, id) GROUP BY r.g
"""


@query(f"WITH {QUESTION_SQL}, {_BLEU}")
def self_bleu(spark, d):
    q = question_corpus(spark, d)
    return corpus.self_bleu(q, "example_id", "domain", questions.words(F.col("text")))


# ---- TF-IDF and embeddings -------------------------------------------------------------------------------------------------------

_TFIDF = """
tf AS (SELECT domain, u AS term, count(*) AS tf FROM (SELECT domain, unnest({tokens}) AS u FROM {rel}) GROUP BY ALL),
df0 AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= {least}),
df AS (SELECT term, df FROM df0 ORDER BY total DESC, term LIMIT {most}),
w0 AS (SELECT domain, term, tf, df, tf * (ln((1.0 + (SELECT count(DISTINCT domain) FROM tf)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term)),
tw AS (SELECT domain, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY domain)) AS weight FROM w0)
"""
_COS = "SELECT a.domain AS group_a, b.domain AS group_b, round(sum(a.weight * b.weight), 4) AS cosine FROM tw a JOIN tw b ON a.term = b.term AND a.domain < b.domain GROUP BY ALL"
_FTOK = _TFIDF.format(tokens="regexp_extract_all(lower(sparql), '[a-z_]\\w*')", rel="paired_examples", least=1, most=5000)


def _formal_weights(spark, d):
    p = read(spark, d, "paired_examples").select("domain", "sparql")
    return corpus.tfidf(p, "domain", F.regexp_extract_all(F.lower("sparql"), F.lit(r"[a-z_]\w*"), F.lit(0)))


@query(f"WITH {_FTOK} {_COS}")
def tfidf_formal_cosine(spark, d):
    return corpus.tfidf_cosine(_formal_weights(spark, d), "domain")


_QTOK = f"{QUESTION_SQL}, z AS (SELECT domain, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x : x NOT IN ({_STOP})) AS v FROM q), zz AS (SELECT domain, list_concat(v, list_transform(range(1, len(v)), lambda i : v[i] || ' ' || v[i+1])) AS v FROM z), " + _TFIDF.format(tokens="v", rel="zz", least=2, most=10000)


def _question_weights(spark, d):
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda x: ~x.isin(*questions.STOP_WORDS))
    q = question_corpus(spark, d).withColumn("_w", w)
    return corpus.tfidf(q, "domain", corpus.unigrams_bigrams(F.col("_w")), most=10000, min_df=2)


@query(f"WITH {_QTOK} {_COS}")
def tfidf_question_cosine(spark, d):
    return corpus.tfidf_cosine(_question_weights(spark, d), "domain")


@query(f"WITH {_QTOK}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY weight DESC, term) AS rank FROM tw WHERE weight > 0) SELECT domain, CAST(rank AS INTEGER) AS rank, term, round(weight, 4) AS weight FROM r WHERE rank <= 20")
def tfidf_top_terms(spark, d):
    return corpus.top_terms(_question_weights(spark, d).withColumn("weight", F.round("weight", 9)), "domain")


ORACLE["tfidf_top_terms"] = ORACLE["tfidf_top_terms"].replace("ORDER BY weight DESC, term", "ORDER BY round(weight, 9) DESC, term")

_UNIT = "u AS (SELECT label, list_transform(embedding, lambda x : CAST(x AS DOUBLE)) AS e, sqrt(list_sum(list_transform(embedding, lambda x : CAST(x AS DOUBLE) * x))) AS n FROM embeddings), x AS (SELECT label, unnest(list_transform(e, lambda v : v / n)) AS x, unnest(range(len(e))) AS i, n FROM u)"


@query(f"WITH {_UNIT}, s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL) SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 4) AS cosine_mean FROM s GROUP BY label")
def embedding_intra_cosine(spark, d):
    return corpus.intra_cosine(read(spark, d, "embeddings"), "label", "embedding")


@query(
    "WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label) "
    "SELECT a.label AS group_a, b.label AS group_b, round(sum(a.m * b.m) / (max(na.norm) * max(nb.norm)), 4) AS cosine FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY a.label, b.label"
)
def embedding_centroid_cosine(spark, d):
    return corpus.centroid_cosine(read(spark, d, "embeddings"), "label", "embedding")


_DIRS = corpus.directions(50, 64)
_WASS = f"""WITH dirs AS (SELECT unnest(range(50)) AS i, unnest([{', '.join('[' + ', '.join(repr(float(x)) for x in r) + ']' for r in _DIRS)}]) AS d),
h AS (SELECT label, i, floor(list_dot_product(list_transform(embedding, lambda x : CAST(x AS DOUBLE)), d) / 0.001) AS bin, count(*) AS c FROM embeddings, dirs GROUP BY ALL),
s AS (SELECT label, i, bin, c / sum(c) OVER (PARTITION BY label, i) AS s FROM h),
r AS (SELECT a.label AS group_a, b.label AS group_b FROM (SELECT DISTINCT label FROM h) a JOIN (SELECT DISTINCT label FROM h) b ON a.label < b.label),
t AS (SELECT group_a, group_b, i, bin, sum(CASE WHEN label = group_a THEN s ELSE -s END) AS s FROM s JOIN r ON label = group_a OR label = group_b GROUP BY ALL),
e AS (SELECT group_a, group_b, i, abs(sum(s) OVER (PARTITION BY group_a, group_b, i ORDER BY bin)) * coalesce(lead(bin) OVER (PARTITION BY group_a, group_b, i ORDER BY bin) - bin, 0) AS a FROM t)
SELECT group_a, group_b, round(avg(w), 4) AS wasserstein FROM (SELECT group_a, group_b, i, sum(a) * 0.001 AS w FROM e GROUP BY ALL) GROUP BY ALL"""


@query(_WASS)
def embedding_wasserstein(spark, d):
    return corpus.sliced_wasserstein(read(spark, d, "embeddings"), "label", "embedding", _DIRS)


# ---- rank statistics ---------------------------------------------------------------------------------------------------------------


def _ranks_sql(cte: str, rel: str, names: list[str]) -> str:
    u = " UNION ALL ".join(f"SELECT '{c}' AS metric, domain AS g, CAST({c} AS DOUBLE) AS x FROM {rel} WHERE {c} IS NOT NULL" for c in names)
    return f"""WITH {cte}, u0 AS ({u}), u AS (SELECT * FROM u0 WHERE (metric, g) IN (SELECT (metric, g) FROM u0 GROUP BY metric, g HAVING count(*) >= 3)),
rk AS (SELECT metric, g, x, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS r FROM u),
gs AS (SELECT metric, g, count(*) AS n, sum(r) AS rs, avg(x) AS mean, var_samp(x) AS v FROM rk GROUP BY ALL),
ts AS (SELECT metric, sum(CAST(c AS DOUBLE) * c * c - c) AS t3 FROM (SELECT metric, x, count(*) AS c FROM u GROUP BY ALL) GROUP BY metric),
k AS (SELECT metric, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(rs * rs / n) AS s FROM gs GROUP BY metric),
h AS (SELECT metric, k, n, CASE WHEN k >= 2 AND 1 - t3 / (CAST(n AS DOUBLE) * n * n - n) > 1e-12 THEN (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * s - 3.0 * (n + 1)) / (1 - t3 / (CAST(n AS DOUBLE) * n * n - n)) END AS h FROM k JOIN ts USING (metric))
"""


_KW = "SELECT metric, k, n, round(h, 3) AS h, round(exp(-h / 2), 5) AS p, round((h - k + 1) / (n - k), 4) AS epsilon_sq, CASE WHEN h IS NULL THEN 'Skipped' WHEN exp(-h / 2) < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM h"


@query(_ranks_sql(FORMAL_SQL, "f", METRIC_NAMES) + _KW)
def kruskal_wallis(spark, d):
    return stats.kruskal(formal_corpus(spark, d), METRIC_NAMES, "domain")


@query(_ranks_sql(QUESTION_SQL, "q", SURFACE_NAMES) + _KW)
def kruskal_wallis_questions(spark, d):
    return stats.kruskal(question_corpus(spark, d), SURFACE_NAMES, "domain")


_Z = "((a.rs / a.n - b.rs / b.n) / sqrt(CAST(k.n AS DOUBLE) * (k.n + 1) / 12.0 * (1.0 / a.n + 1.0 / b.n)))"


@query(
    _ranks_sql(FORMAL_SQL, "f", METRIC_NAMES)
    + f", z AS (SELECT a.metric, a.g AS group_a, b.g AS group_b, {_Z} AS z, k.k AS k, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sp, a.mean - b.mean AS dm FROM gs a JOIN gs b ON a.metric = b.metric AND a.g < b.g JOIN k ON k.metric = a.metric) "
    + f"SELECT metric, group_a, group_b, round(z, 4) AS z, round(least(1.0, 2 * {normal_tail_sql('z')} * k * (k - 1) / 2), 5) AS p_adj, round(CASE WHEN sp = 0 THEN 0.0 ELSE dm / sp END, 4) AS d FROM z"
)
def dunn_pairs(spark, d):
    return stats.dunn(formal_corpus(spark, d), METRIC_NAMES, "domain")


# ---- paired evaluation -------------------------------------------------------------------------------------------------------------

_METHODS = ("nlq", *values.CHALLENGERS)
_ALIGN = f"{LONG_SQL}, al AS (SELECT domain, model, query_id, {', '.join(f"median(CASE WHEN method = '{c}' AND isfinite(kd) THEN kd END) AS {c}" for c in _METHODS)} FROM m GROUP BY domain, model, query_id), pr AS (SELECT domain, model, query_id, {', '.join(f'CASE WHEN {c} > 0 THEN log10({c}) END AS {c}' for c in _METHODS)} FROM al)"


@query(f"WITH {_ALIGN} SELECT domain, model, query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _METHODS)} FROM pr")
def aligned_pairs(spark, d):
    p = pairing.aligned(long_metrics(spark, d), "kd", log=True)
    return p.select("domain", "model", "query_id", *[F.round(c, 6).alias(c) for c in _METHODS])


_WR = ", ".join(f"count(*) FILTER ({c} IS NOT NULL AND nlq IS NOT NULL) AS n_{c}, round(100.0 * count(*) FILTER ({c} > nlq) / nullif(count(*) FILTER ({c} IS NOT NULL AND nlq IS NOT NULL), 0), 1) AS wr_{c}" for c in values.CHALLENGERS)


@query(f"""WITH {_ALIGN}, r AS (SELECT domain, model, {_WR} FROM pr GROUP BY domain, model),
u AS (SELECT domain, model, c, rate, row_number() OVER (PARTITION BY domain, model ORDER BY rate DESC, i) AS k FROM (SELECT domain, model, 'sparql' AS c, 0 AS i, wr_sparql AS rate FROM r UNION ALL SELECT domain, model, 'nlq_cot', 1, wr_nlq_cot FROM r UNION ALL SELECT domain, model, 'sparql_cot', 2, wr_sparql_cot FROM r) WHERE rate IS NOT NULL)
SELECT r.*, a.c AS best, a.rate AS best_rate, b.c AS runner_up, round(a.rate - b.rate, 1) AS delta_best, coalesce(wr_sparql > wr_nlq_cot AND wr_sparql > wr_sparql_cot, false) AS sp_bold FROM r LEFT JOIN u a ON a.domain = r.domain AND a.model = r.model AND a.k = 1 LEFT JOIN u b ON b.domain = r.domain AND b.model = r.model AND b.k = 2""")
def win_rate_table(spark, d):
    return pairing.win_rates(pairing.aligned(long_metrics(spark, d), "kd", log=True))


@query(f"WITH {_ALIGN}, fl AS (SELECT model, query_id, {', '.join(f'coalesce(max(CAST({c} > nlq AS INTEGER)), 0) AS {c}' for c in values.CHALLENGERS)} FROM pr GROUP BY ALL) SELECT model, sparql, nlq_cot, sparql_cot, count(*) AS n FROM fl WHERE sparql + nlq_cot + sparql_cot > 0 GROUP BY ALL")
def win_regions(spark, d):
    return pairing.win_regions(pairing.aligned(long_metrics(spark, d), "kd", log=True))


_SIGNED = f"{_ALIGN}, dl AS (SELECT domain, model, 'sparql' AS method, sparql - nlq AS d FROM pr UNION ALL SELECT domain, model, 'nlq_cot', nlq_cot - nlq FROM pr UNION ALL SELECT domain, model, 'sparql_cot', sparql_cot - nlq FROM pr)"
_WILCOXON = """nz AS (SELECT *, abs(d) AS a FROM dl WHERE d IS NOT NULL AND round(d, 12) <> 0), ra AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY a) + (count(*) OVER (PARTITION BY {k}, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {k}, a) AS t FROM nz),
s AS (SELECT {k}, count(*) AS n_nonzero, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0.0) AS w_minus, sum(CAST(t AS DOUBLE) * t - 1) AS t3 FROM ra GROUP BY ALL),
zz AS (SELECT *, (least(w_plus, w_minus) - n_nonzero * (n_nonzero + 1) / 4.0) / sqrt((CAST(n_nonzero AS DOUBLE) * (n_nonzero + 1) * (2 * n_nonzero + 1) - t3 / 2.0) / 24.0) AS z FROM s)"""


def _deltas(spark, d):
    p = pairing.aligned(long_metrics(spark, d), "kd", log=True)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.round(F.col(c) - F.col("nlq"), 12).alias("d")) for c in values.CHALLENGERS]))
    return p.select("domain", "model", rows.alias("r")).select("domain", "model", "r.*")


@query(f"WITH {_SIGNED.replace('sparql - nlq AS d', 'round(sparql - nlq, 12) AS d').replace('nlq_cot - nlq FROM', 'round(nlq_cot - nlq, 12) FROM').replace('sparql_cot - nlq FROM', 'round(sparql_cot - nlq, 12) FROM')}, {_WILCOXON.format(k='domain, model, method')} SELECT domain, model, method, n_nonzero, w_plus, w_minus, CASE WHEN n_nonzero >= 5 THEN round(least(w_plus, w_minus), 4) END AS statistic, CASE WHEN n_nonzero >= 5 THEN round(z, 4) END AS z, CASE WHEN n_nonzero >= 5 THEN round(2 * {normal_tail_sql('z')}, 6) END AS p FROM zz")
def wilcoxon_signed_rank(spark, d):
    """With the normal approximation for groups of any size, as its SQL has it."""
    return stats.wilcoxon(_deltas(spark, d), ["domain", "model", "method"], "d", most_exact=0)


@query()
def wilcoxon_signed_rank_exact(spark, d):
    """The same with exact probabilities for small groups without ties or zeros."""
    return stats.wilcoxon(_deltas(spark, d), ["domain", "model", "method"], "d")


_CELLS = f"""{LONG_SQL}, ff AS (SELECT model, domain, method, query_id, {_FIN.format('recall')} AS r, {_FIN.format('claim_recall')} AS c FROM m),
jj AS (SELECT a.method, a.domain, a.model, a.r, b.r AS br, a.c, b.c AS bc FROM ff a JOIN ff b ON a.model = b.model AND a.domain = b.domain AND a.query_id = b.query_id AND b.method = 'nlq' WHERE a.method <> 'nlq'),
cells AS (SELECT method, domain, model, count(*) FILTER (r IS NOT NULL AND br IS NOT NULL) AS n_total, count(*) FILTER (r > br) AS win_count, count(*) FILTER (r > br AND c IS NOT NULL AND bc IS NOT NULL) AS n_claims,
 round(avg(c) FILTER (r > br AND c IS NOT NULL AND bc IS NOT NULL), 4) AS ch_cr, round(avg(bc) FILTER (r > br AND c IS NOT NULL AND bc IS NOT NULL), 4) AS nlq_cr, round(avg(c - bc) FILTER (r > br AND c IS NOT NULL AND bc IS NOT NULL), 4) AS delta_cr, round(avg(r - br) FILTER (r > br), 4) AS delta_recall,
 round(100.0 * count(*) FILTER (r > br) / nullif(count(*) FILTER (r IS NOT NULL AND br IS NOT NULL), 0), 2) AS recall_win_rate FROM jj GROUP BY ALL),
cc AS (SELECT *, coalesce(delta_cr > 0, false) AS co_directional FROM cells)"""


@query(f"WITH {_CELLS} SELECT * FROM cc")
def delta_cr_recall_wins(spark, d):
    return pairing.delta_on_wins(long_metrics(spark, d))


@query(f"WITH {_CELLS} SELECT method, round(round(avg(recall_win_rate), 8), 2) AS mean_win_rate, round(round(avg(delta_cr), 8), 4) AS mean_delta_cr, count(*) FILTER (co_directional) AS n_codir, count(*) AS n_cells, round(100.0 * count(*) FILTER (co_directional) / count(*), 1) AS pct_codir FROM cc GROUP BY method")
def challenger_summary(spark, d):
    return pairing.challenger_summary(pairing.delta_on_wins(long_metrics(spark, d)))


@query(f"WITH {_CELLS}, pv AS (SELECT model, domain, {', '.join(f"max(recall_win_rate) FILTER (method = '{c}') AS {c}_win_rate, max(delta_cr) FILTER (method = '{c}') AS {c}_delta_cr" for c in values.CHALLENGERS)} FROM cc GROUP BY model, domain) SELECT *, round(sparql_delta_cr - nlq_cot_delta_cr, 4) AS delta_sparql_nlq_cot FROM pv")
def primary_pivot(spark, d):
    return pairing.primary_pivot(pairing.delta_on_wins(long_metrics(spark, d)))


@query(f"WITH {LONG_SQL} SELECT method, count({_FIN.format('kd')}) AS n, quantile_cont({_FIN.format('kd')}, 0.0) AS low, quantile_cont({_FIN.format('kd')}, 0.25) AS q1, quantile_cont({_FIN.format('kd')}, 0.5) AS mid, quantile_cont({_FIN.format('kd')}, 0.75) AS q3, quantile_cont({_FIN.format('kd')}, 1.0) AS high, coalesce(max({_FIN.format('kd')}) / min(CASE WHEN kd > 0 AND isfinite(kd) THEN kd END) > 20, false) AS log_scale FROM m GROUP BY method")
def box_stats(spark, d):
    return pairing.box_stats(long_metrics(spark, d), "kd")


# ---- latent displacement -----------------------------------------------------------------------------------------------------------

_LAT = f"""{LONG_SQL}, l0 AS (SELECT model, domain, method, query_id, seen_at, {_FIN.format('kd')} AS seconds, {_FIN.format('recall')} AS confidence, CAST(input_length AS DOUBLE) AS prompt_len, CAST(generated_length AS DOUBLE) AS answer_len, {_FIN.format('claim_recall')} AS rate FROM m),
l1 AS (SELECT model, domain, method, query_id, seen_at, coalesce(seconds, 0.0) AS seconds, coalesce(confidence, 0.0) AS confidence, coalesce(prompt_len, 0.0) AS prompt_len, coalesce(answer_len, 0.0) AS answer_len, coalesce(rate, 0.0) AS rate FROM l0 WHERE {' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in LATENT)} <= 2),
l2 AS (SELECT *, row_number() OVER (PARTITION BY model, domain, method, query_id ORDER BY seen_at, seconds, confidence, prompt_len, answer_len, rate) AS k FROM l1),
l AS (SELECT model, domain, method, query_id, {', '.join(LATENT)} FROM l2 WHERE k = 1), mo AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}' for c in LATENT)} FROM l),
zs AS (SELECT model, domain, method, query_id, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in LATENT)} FROM l, mo)"""
_V = lambda t: "[" + ", ".join(f"{t}.{c}" for c in LATENT) + "]"
_ANG = f"""{_LAT}, pa AS (SELECT c.domain, c.model, c.method, c.query_id, c.seconds - b.seconds AS ds, CASE WHEN sqrt(list_dot_product({_V('c')}, {_V('c')})) < 1e-12 OR sqrt(list_dot_product({_V('b')}, {_V('b')})) < 1e-12 THEN 0.0 ELSE list_dot_product({_V('c')}, {_V('b')}) / (sqrt(list_dot_product({_V('c')}, {_V('c')})) * sqrt(list_dot_product({_V('b')}, {_V('b')}))) END AS cs
 FROM zs c JOIN zs b ON b.method = 'nlq' AND c.model = b.model AND c.domain = b.domain AND c.query_id = b.query_id WHERE c.method <> 'nlq'),
an AS (SELECT domain, model, method, query_id, CASE WHEN ds < 0 THEN -1 ELSE 1 END * degrees(acos(greatest(-1.0, least(1.0, cs)))) AS angle FROM pa)"""


@query(f"WITH {_LAT} SELECT model, domain, method, query_id, {', '.join(f'round({c}, 5) AS {c}' for c in LATENT)} FROM zs")
def zscore(spark, d):
    z = latent.zscores(latent_rows(spark, d), LATENT)
    return z.select("model", "domain", "method", "query_id", *[F.round(c, 5).alias(c) for c in LATENT])


def _angles(spark, d):
    return durable(latent.signed_angles(latent.zscores(durable(latent_rows(spark, d)), LATENT), LATENT, "seconds"))


@query(f"WITH {_ANG} SELECT domain, model, method, query_id, round(angle, 3) AS angle FROM an")
def signed_angles(spark, d):
    return _angles(spark, d).withColumn("angle", F.round("angle", 3))


@query(f"WITH {_ANG}, st AS (SELECT domain, model, method, count(*) AS n, round(avg(angle), 4) AS mean, round(median(angle), 4) AS median, round(coalesce(stddev_samp(angle), 0.0), 4) AS std, round(100.0 * count(*) FILTER (angle > 0) / count(*), 2) AS pct_pos, round(100.0 * count(*) FILTER (angle < 0) / count(*), 2) AS pct_neg, CASE WHEN coalesce(stddev_samp(angle), 0.0) > 1e-12 THEN round(avg(angle) / stddev_samp(angle), 4) END AS cohens_d FROM an GROUP BY ALL) SELECT * FROM st")
def angle_stats(spark, d):
    return latent.angle_stats(_angles(spark, d)).drop("statistic", "p")


@query()
def angle_signed_rank(spark, d):
    """The signed-rank test of the angles, which the SQL of angle_stats leaves out."""
    return latent.angle_stats(_angles(spark, d)).select("domain", "model", "method", "n", "statistic", "p")


@query(f"WITH {_ANG}, st AS (SELECT domain, model, method, round(avg(angle), 4) AS mean FROM an GROUP BY ALL) SELECT model, domain, method, mean FROM st WHERE method = 'sparql' ORDER BY abs(mean) DESC, model, domain LIMIT 1")
def largest_displacement(spark, d):
    return latent.largest_displacement(latent.mean_angles(_angles(spark, d)))


@query(f"WITH {_ANG}, st AS (SELECT domain, model, method, round(avg(angle), 4) AS mean FROM an GROUP BY ALL) SELECT model, domain, count(*) AS n_methods, count(DISTINCT sign(mean)) AS n_signs FROM st GROUP BY model, domain HAVING count(*) = 3 AND count(DISTINCT sign(mean)) > 1")
def direction_flips(spark, d):
    return latent.direction_flips(latent.mean_angles(_angles(spark, d)))


@query()
def angle_bootstrap_ci(spark, d):
    return stats.bootstrap_ci(_angles(spark, d), ["domain", "model", "method"], "angle", "query_id")


# ---- harness and ingestion ---------------------------------------------------------------------------------------------------------

_RAWM = "mm AS (SELECT *, regexp_replace(lower(trim(query_mode)), '[^a-z0-9]+', '_', 'g') AS method FROM inference_metrics), lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, query_id, method ORDER BY processing_timestamp DESC NULLS LAST, input_length DESC NULLS LAST, generated_length DESC NULLS LAST, generation_time_seconds DESC NULLS LAST, confidence_score DESC NULLS LAST) AS k FROM mm WHERE method IN ('nlq', 'nlq_cot', 'sparql', 'sparql_cot')) WHERE k = 1)"


@query(f"WITH {_RAWM} SELECT model, query_id, {', '.join(f"max(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END) FILTER (method = '{m}') AS {m}_{c}" for m in values.METHODS for c in harness.METRICS)} FROM lm GROUP BY model, query_id")
def mode_pivot(spark, d):
    p = harness.metric_pivot(read(spark, d, "inference_metrics"))
    return p.select("model", "query_id", *[F.col(c).cast("double").alias(c) for c in p.columns[2:]])


@query("SELECT regexp_replace(lower(trim(query_mode)), '[^a-z0-9]+', '_', 'g') AS method, count(*) AS n, round(avg(generation_time_seconds), 4) AS mean_seconds, round(avg(CASE WHEN isfinite(confidence_score) THEN confidence_score END), 4) AS mean_confidence, round(avg(generated_length), 2) AS mean_length FROM inference_metrics WHERE query_mode IS NOT NULL GROUP BY ALL")
def method_averages(spark, d):
    return harness.method_averages(read(spark, d, "inference_metrics"))


_ID = "CASE WHEN isfinite(TRY_CAST(trim({0}) AS DOUBLE)) AND abs(TRY_CAST(trim({0}) AS DOUBLE)) < 9e18 THEN CAST(trunc(TRY_CAST(trim({0}) AS DOUBLE)) AS BIGINT) END"


@query(f"SELECT qa_id, query_id, coalesce(CASE WHEN n < 0 THEN '-' || CASE WHEN length(CAST(-n AS VARCHAR)) < 5 THEN lpad(CAST(-n AS VARCHAR), 5, '0') ELSE CAST(-n AS VARCHAR) END WHEN length(CAST(n AS VARCHAR)) < 6 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END, trim(query_id)) AS query_key FROM (SELECT qa_id, query_id, {_ID.format('query_id')} AS n FROM raw_qa)")
def id_normalise(spark, d):
    q = read(spark, d, "raw_qa")
    return q.select("qa_id", "query_id", values.query_key(F.col("query_id")).alias("query_key"))


@query(f"SELECT query_number, ground_truth FROM (SELECT {_ID.format('query_id')} AS query_number, CASE WHEN ground_truth IS NULL OR trim(ground_truth, ' ') = '' THEN '[EMPTY]' ELSE ground_truth END AS ground_truth, row_number() OVER (PARTITION BY {_ID.format('query_id')} ORDER BY loaded_at DESC, ground_truth DESC NULLS LAST) AS k FROM raw_qa) WHERE k = 1")
def last_ground_truth(spark, d):
    q = read(spark, d, "raw_qa").withColumn("query_number", values.query_number(F.col("query_id")))
    return harness.last_truth(q, "query_number", "ground_truth", "loaded_at")


@query(f"SELECT q.qa_id, q.domain FROM raw_qa q WHERE NOT EXISTS (SELECT 1 FROM all_models_responses r WHERE r.query_id = {_ID.format('q.query_id')} AND r.nlq_response IS NOT NULL AND NOT starts_with(r.nlq_response, 'ERROR') AND NOT starts_with(r.nlq_response, 'DEGENERATE_OUTPUT:'))")
def resume_pending(spark, d):
    todo = read(spark, d, "raw_qa").select("qa_id", "domain", values.query_number(F.col("query_id")).alias("query_id"))
    done = read(spark, d, "all_models_responses").filter(F.col("nlq_response").isNotNull() & ~values.is_error(F.col("nlq_response")))
    return harness.pending(todo, done, "query_id").select("qa_id", "domain")


@query("WITH a AS (SELECT model, unnest(['nlq', 'nlq_cot', 'sparql', 'sparql_cot']) AS method, unnest([nlq_response, nlq_cot_response, sparql_response, sparql_cot_response]) AS response FROM all_models_responses) SELECT model, method, count(*) AS total, count(*) FILTER (NOT coalesce(starts_with(response, 'ERROR') OR starts_with(response, 'DEGENERATE_OUTPUT:'), false)) AS successful, count(*) FILTER (starts_with(response, 'ERROR') OR starts_with(response, 'DEGENERATE_OUTPUT:')) AS errors FROM a GROUP BY ALL")
def run_counts(spark, d):
    return harness.run_counts(answers(spark, d), ["model", "method"], "response")


BLOCKS = {m: ["You answer questions about contracts, accounts and lines.", "Use only what the question gives.", *(["Think step by step."] if m.endswith("cot") else []), *(["The question comes as a formal query."] if m.startswith("sparql") else [])] for m in values.METHODS}


def _prompt_sql() -> str:
    parts = []
    for m, b in BLOCKS.items():
        head = " || chr(10) || ".join(f"'{x}'" for x in b)
        q = "coalesce(sparql_query, '')" if m.startswith("sparql") else "coalesce(question, '')"
        parts.append(f"SELECT resp_id, '{m}' AS method, {head} || chr(10) || 'ID: ' || query_id || chr(10) || 'QUERY: ' || {q} || chr(10) || '{'THINK:' if m.endswith('cot') else 'ANSWER:'}' AS prompt FROM all_models_responses")
    return " UNION ALL ".join(parts)


@query(_prompt_sql())
def prompts(spark, d):
    r = read(spark, d, "all_models_responses").select("resp_id", "query_id", "question", "sparql_query", F.explode(F.array(*[F.lit(m) for m in values.METHODS])).alias("method"))
    text = F.when(F.startswith("method", F.lit("sparql")), F.col("sparql_query")).otherwise(F.col("question"))
    return r.select("resp_id", "method", harness.prompt(BLOCKS, F.col("method"), F.col("query_id"), text).alias("prompt"))


@query("SELECT p.resp_id, replace('<s>[INST] {prompt} [/INST]', '{prompt}', coalesce(p.question, '')) AS wrapped FROM all_models_responses p JOIN model_config c ON c.name = p.model WHERE c.prefer_4bit UNION ALL SELECT p.resp_id, coalesce(p.question, '') FROM all_models_responses p JOIN model_config c ON c.name = p.model WHERE NOT c.prefer_4bit")
def chat_wrapped(spark, d):
    t = read(spark, d, "model_config").filter("prefer_4bit").select(F.col("name").alias("model"), F.lit("<s>[INST] {prompt} [/INST]").alias("template"))
    known = read(spark, d, "model_config").select(F.col("name").alias("model"))
    r = read(spark, d, "all_models_responses").select("resp_id", "model", F.coalesce("question", F.lit("")).alias("question")).join(known, "model", "left_semi")
    return harness.wrapped(r, t, "model", "question").select("resp_id", "wrapped")


@query("SELECT doc_ref, CASE WHEN regexp_matches(lower(source), 'fiqa|finance|financial|fin_') THEN 'finance' WHEN regexp_matches(lower(source), 'legal|law') THEN 'legal' WHEN regexp_matches(lower(source), 'telco|telecom') THEN 'telco' ELSE 'unknown' END AS path_domain, count(*) AS n FROM documents GROUP BY ALL")
def path_domain(spark, d):
    return read(spark, d, "documents").groupBy("doc_ref", values.domain_of_path(F.col("source")).alias("path_domain")).agg(F.count("*").alias("n"))


@query("SELECT resp_id, model, nlq_response AS baseline, CAST(NULL AS VARCHAR) AS absent FROM all_models_responses WHERE NOT coalesce(lower(trim(nlq_response, ' ')) IN ('', 'nan', 'none', 'n/a'), true)")
def reindexed_columns(spark, d):
    r = read(spark, d, "all_models_responses").filter(~values.is_missing_text(F.col("nlq_response")))
    return sinks.reindexed(r.withColumnRenamed("nlq_response", "baseline"), ["resp_id", "model", "baseline", "absent"])


# ---- response text -----------------------------------------------------------------------------------------------------------------

_ANS = "a AS (SELECT resp_id, model, domain, unnest(['nlq', 'nlq_cot', 'sparql', 'sparql_cot']) AS method, unnest([nlq_response, nlq_cot_response, sparql_response, sparql_cot_response]) AS response FROM all_models_responses)"


@query(f"WITH {_ANS} SELECT resp_id, method, regexp_replace(regexp_replace(regexp_replace(response, '(?is)^.*answer\\s*[*]*\\s*:', ''), '^[^\\p{{L}}\\p{{N}}_(]+', ''), '^\\s+|\\s+$', '', 'g') AS cleaned FROM a WHERE response IS NOT NULL")
def clean_response(spark, d):
    return answers(spark, d).filter("response is not null").select("resp_id", "method", questions.clean_response(F.col("response")).alias("cleaned"))


@query(
    f"WITH {_ANS}, s AS (SELECT resp_id, method, unnest(string_split(regexp_replace(response, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS c FROM a WHERE response IS NOT NULL) "
    "SELECT resp_id, method, count(*) AS n_claims FROM s WHERE len(regexp_extract_all(c, '\\S+')) >= 5 GROUP BY ALL"
)
def claims(spark, d):
    a = answers(spark, d).filter("response is not null").select("resp_id", "method", F.size(questions.claims(F.col("response"))).cast("bigint").alias("n_claims"))
    return a.filter("n_claims > 0")


@query()
def degenerate_flags(spark, d):
    return answers(spark, d).filter("response is not null").select("resp_id", "method", questions.degenerate(F.col("response")).alias("kind")).filter("kind is not null")


@query()
def structural_triples(spark, d):
    return triples.extract(answers(spark, d).filter("response is not null"), ["resp_id", "method"], "response", SURFACES)


@query()
def entity_spans(spark, d):
    return triples.entity_spans(read(spark, d, "raw_qa").select("qa_id", "question"), ["qa_id"], "question", SURFACES)


@query("SELECT qa_id, (SELECT s FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in sorted(SURFACES, key=lambda s: (-len(s), s))) + "]) AS s, unnest(range(" + str(len(SURFACES)) + ")) AS i) WHERE contains(lower(question), s) ORDER BY i LIMIT 1) AS form FROM raw_qa")
def contained_form(spark, d):
    voc = spark.createDataFrame([(s,) for s in SURFACES], "surface string")
    return triples.contained_form(read(spark, d, "raw_qa").select("qa_id", "question"), "question", voc).select("qa_id", "form")


def _density(spark, d):
    a = answers(spark, d).filter("response is not null").select("resp_id", "model", "method", "response")
    t = triples.extract(a, ["resp_id", "method"], "response", SURFACES)
    c = t.groupBy("resp_id", "method").agg(F.count("*").alias("n_triples"), F.count_if(F.col("confidence") >= triples.CONFIDENT).alias("typed"))
    j = a.join(c, ["resp_id", "method"], "left").na.fill(0, ["n_triples", "typed"])
    return j.select("resp_id", "model", "method", "n_triples", "typed", questions.density(F.col("typed"), F.col("response")).alias("kd"))


@query()
def kd_metrics(spark, d):
    return _density(spark, d)


@query(f"WITH {LONG_SQL} SELECT model, method, count(*) AS n, {', '.join(f'round(coalesce(avg({c}), 0.0), 4) AS {c}_mean, round(coalesce(stddev_pop({c}), 0.0), 4) AS {c}_std, round(coalesce(CAST(min({c}) AS DOUBLE), 0.0), 4) AS {c}_min, round(coalesce(CAST(max({c}) AS DOUBLE), 0.0), 4) AS {c}_max' for c in ('kd', 'generated_length'))} FROM m GROUP BY ALL")
def tkf_aggregate(spark, d):
    return triples.tkf(long_metrics(spark, d).withColumn("generated_length", F.col("generated_length").cast("double")), ["model", "method"], ["kd", "generated_length"])


_EP = ", ".join(f"avg(kd) FILTER (method = '{m}') AS {m}" for m in values.METHODS)
_EPB = "CASE " + " ".join(f"WHEN {m} = greatest({', '.join(values.METHODS)}) THEN '{m}'" for m in values.METHODS) + " END AS best"


@query(f"WITH {LONG_SQL}, e AS (SELECT model, {_EP} FROM m GROUP BY model UNION ALL SELECT 'MEAN', {_EP} FROM m) SELECT model, {', '.join(f'round({m}, 4) AS {m}' for m in values.METHODS)}, {_EPB}, round(greatest({', '.join(values.METHODS)}), 4) AS best_score, round(greatest({', '.join(values.METHODS)}) - least({', '.join(values.METHODS)}), 4) AS spread FROM e")
def extractor_pivot(spark, d):
    return triples.extractor_pivot(long_metrics(spark, d), "model", list(values.METHODS), "kd", "method")


@query(f"WITH {LONG_SQL}, s AS (SELECT model, method, count(*) AS n, round(avg(kd), 4) AS kd_mean FROM m GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY kd_mean DESC NULLS LAST, model, method) AS INTEGER) AS rank FROM s")
def leaderboard(spark, d):
    s = long_metrics(spark, d).groupBy("model", "method").agg(F.count("*").alias("n"), F.round(F.avg("kd"), 4).alias("kd_mean"))
    return triples.leaderboard(s, "kd_mean", ["model", "method"])


# ---- graph-pattern algebra ---------------------------------------------------------------------------------------------------------


def graph(spark, d) -> DataFrame:
    """Triples of the star schema: customers, nations, regions, orders, and the status of finished orders."""
    c, n, r, o = (read(spark, d, x) for x in ("customer", "nation", "region", "orders"))
    s = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    parts = [
        c.select(s("c", "c_custkey").alias("s"), F.lit("inNation").alias("p"), s("n", "c_nationkey").alias("o")),
        c.select(s("c", "c_custkey").alias("s"), F.lit("segment").alias("p"), F.col("c_mktsegment").alias("o")),
        n.select(s("n", "n_nationkey").alias("s"), F.lit("inRegion").alias("p"), s("r", "n_regionkey").alias("o")),
        r.select(s("r", "r_regionkey").alias("s"), F.lit("label").alias("p"), F.col("r_name").alias("o")),
        o.select(s("o", "o_orderkey").alias("s"), F.lit("by").alias("p"), s("c", "o_custkey").alias("o")),
        o.filter("o_orderstatus = 'F'").select(s("o", "o_orderkey").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o")),
    ]
    return algebra.union(*parts)


_G = """t AS (SELECT 'c' || c_custkey AS s, 'inNation' AS p, 'n' || c_nationkey AS o FROM customer UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT 'n' || n_nationkey, 'inRegion', 'r' || n_regionkey FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'label', r_name FROM region UNION ALL SELECT 'o' || o_orderkey, 'by', 'c' || o_custkey FROM orders UNION ALL SELECT 'o' || o_orderkey, 'status', o_orderstatus FROM orders WHERE o_orderstatus = 'F')"""


@query(f"WITH {_G} SELECT l.o AS region, count(*) AS n FROM t a JOIN t b ON a.o = b.s AND b.p = 'inRegion' JOIN t l ON b.o = l.s AND l.p = 'label' WHERE a.p = 'inNation' GROUP BY l.o HAVING count(*) > 0")
def graph_bgp_grouped(spark, d):
    t = graph(spark, d)
    sol = algebra.bgp(t, ("?c", "inNation", "?n"), ("?n", "inRegion", "?r"), ("?r", "label", "?region"))
    return algebra.grouped(sol, ["region"], {"n": F.count("*")}, F.col("n") > 0)


@query(f"WITH {_G} SELECT a.s AS o, b.o AS st FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = 'status' WHERE a.p = 'by'")
def graph_optional(spark, d):
    t = graph(spark, d)
    return algebra.optional(algebra.pattern(t, "?o", "by", "?c"), algebra.pattern(t, "?o", "status", "?st")).select("o", "st")


@query(f"WITH {_G} SELECT s AS o FROM t WHERE p = 'by' AND NOT EXISTS (SELECT 1 FROM t x WHERE x.p = 'status' AND x.s = t.s)")
def graph_not_exists(spark, d):
    t = graph(spark, d)
    return algebra.not_exists(algebra.pattern(t, "?o", "by", "?c"), algebra.pattern(t, "?o", "status", "?st")).select("o")


@query(f"WITH {_G} SELECT s AS o, o AS c FROM t WHERE p = 'by' AND s NOT IN (SELECT s FROM t WHERE p = 'status')")
def graph_minus(spark, d):
    """Orders without a status; a right side that shares no variable would take nothing away."""
    t = graph(spark, d)
    left = algebra.minus(algebra.pattern(t, "?o", "by", "?c"), algebra.pattern(t, "?x", "label", "EUROPE").select("x"))
    return algebra.minus(left, algebra.pattern(t, "?o", "status", "?st"))


@query(f"WITH {_G}, n AS (SELECT o AS c, count(*) AS n FROM t WHERE p = 'by' GROUP BY o HAVING count(*) >= 3) SELECT t.s AS c, n.n, t.o AS seg FROM n JOIN t ON t.s = n.c AND t.p = 'segment' WHERE starts_with(t.o, 'B') OR regexp_matches(t.o, '(?i)^auto')")
def graph_filters(spark, d):
    """A subquery with HAVING, joined, and filters by STRSTARTS and REGEX."""
    t = graph(spark, d)
    often = algebra.grouped(algebra.pattern(t, "?o", "by", "?c"), ["c"], {"n": F.count("*")}, F.col("n") >= 3)
    seg = algebra.pattern(t, "?c", "segment", "?seg")
    kept = algebra.union(algebra.starts(seg, "seg", "B"), algebra.matches(seg, "seg", "^auto", ignore_case=True))
    return algebra.subquery(kept, often).select("c", "n", "seg")


@query("SELECT r_regionkey AS k, '<https://example.org/r' || r_regionkey || '>' AS iri, '\"' || r_name || '\"@en' AS label, 'en' AS lang, r_name AS str, 'xsd:integer' AS kind FROM region")
def graph_terms(spark, d):
    """Prefixed names, literals with language and datatype, and what STR, LANG and DATATYPE say of them."""
    r = read(spark, d, "region")
    label = algebra.literal(F.col("r_name"), lang="en")
    number = algebra.literal(F.col("r_regionkey").cast("string"), datatype="xsd:integer")
    return r.select(F.col("r_regionkey").alias("k"), algebra.expanded(F.concat(F.lit("ex:r"), F.col("r_regionkey").cast("string")), {"ex": "https://example.org/"}).alias("iri"), label.alias("label"), algebra.lang(label).alias("lang"), algebra.string(label).alias("str"), algebra.datatype(number).alias("kind"))


@query(f"WITH {_G} SELECT o AS region, sum(CAST(substr(s, 2) AS BIGINT)) AS total, avg(CAST(substr(s, 2) AS BIGINT)) AS mean, min(CAST(substr(s, 2) AS BIGINT)) AS least, max(CAST(substr(s, 2) AS BIGINT)) AS most FROM t WHERE p = 'inRegion' GROUP BY o")
def graph_aggregates(spark, d):
    """SUM, AVG, MIN and MAX over a bound number."""
    sol = algebra.bind(algebra.pattern(graph(spark, d), "?n", "inRegion", "?region"), "k", F.substring("n", 2, 20).cast("bigint"))
    return algebra.grouped(sol, ["region"], {"total": F.sum("k"), "mean": F.avg("k"), "least": F.min("k"), "most": F.max("k")})


@query(f"WITH {_G} SELECT t.s AS n, t.o AS r FROM t JOIN (VALUES ('r1'), ('r3')) v(o) ON v.o = t.o WHERE t.p = 'inRegion'")
def graph_values(spark, d):
    """VALUES joined with a pattern."""
    v = algebra.values(spark, "r", ["r1", "r3"])
    return algebra.subquery(algebra.pattern(graph(spark, d), "?n", "inRegion", "?r"), v)


@query(f"WITH {_G} SELECT s AS c FROM t WHERE p = 'inNation' AND EXISTS (SELECT 1 FROM t x WHERE x.p = 'by' AND x.o = t.s)")
def graph_exists(spark, d):
    t = graph(spark, d)
    return algebra.exists(algebra.pattern(t, "?c", "inNation", "?n"), algebra.pattern(t, "?o", "by", "?c")).select("c")


@query(f"WITH {_G} SELECT DISTINCT x FROM (SELECT s AS x FROM t WHERE p = 'segment' AND o = 'BUILDING' UNION ALL SELECT s FROM t WHERE p = 'inRegion') ORDER BY x DESC LIMIT 50")
def graph_union_ordered(spark, d):
    t = graph(spark, d)
    u = algebra.union(algebra.pattern(t, "?x", "segment", "BUILDING"), algebra.pattern(t, "?x", "inRegion", "?r").select("x"))
    return algebra.select(u, ["x"], distinct=True, order=[F.desc("x")], limit=50)


@query(f"WITH {_G} SELECT count(*) > 0 AS answer FROM t WHERE p = 'label' AND o = 'EUROPE'")
def graph_ask(spark, d):
    return algebra.ask(algebra.pattern(graph(spark, d), "?r", "label", "EUROPE"))


@query(f"WITH {_G} SELECT s, p, o FROM t WHERE s = 'c1'")
def graph_describe(spark, d):
    return algebra.describe(graph(spark, d), "c1")


@query(f"WITH {_G} SELECT DISTINCT a.s AS s, 'residesIn' AS p, b.o AS o FROM t a JOIN t b ON a.o = b.s AND b.p = 'inRegion' WHERE a.p = 'inNation'")
def graph_construct(spark, d):
    t = graph(spark, d)
    return algebra.construct(algebra.bgp(t, ("?c", "inNation", "?n"), ("?n", "inRegion", "?r")), ("?c", "residesIn", "?r"))


# ---- value functions ---------------------------------------------------------------------------------------------------------------


@query(
    "SELECT resp_id, query_mode, CASE WHEN isfinite(confidence_score) THEN greatest(-1e8, least(1e8, confidence_score)) ELSE 0.5 END AS guarded, round(CASE WHEN generation_time_seconds > 0 THEN log10(generation_time_seconds) END, 6) AS log_seconds, "
    "round(coalesce(CAST(generated_length AS DOUBLE) / nullif(CAST(input_length AS DOUBLE), 0), 0.0), 6) AS rate FROM inference_metrics"
)
def safe_numbers(spark, d):
    m = read(spark, d, "inference_metrics")
    rate = values.safe_div(F.col("generated_length").cast("double"), F.col("input_length").cast("double"))
    return m.select("resp_id", "query_mode", values.guarded(F.col("confidence_score")).alias("guarded"), F.round(values.log10_safe(F.col("generation_time_seconds")), 6).alias("log_seconds"), F.round(rate, 6).alias("rate"))


@query(f"WITH {LONG_SQL} SELECT model, method, query_id, arg_min(recall, seen_at) FILTER (isfinite(recall)) AS recall FROM m GROUP BY ALL")
def first_per_key(spark, d):
    m = long_metrics(spark, d).withColumn("recall", values.finite(F.col("recall")))
    return latent.first_per_key(m, ["model", "method", "query_id"], "at", ["recall"])


@query(f"WITH {_LAT} SELECT model, domain, method, query_id, {', '.join(f'round({c}, 6) AS {c}' for c in LATENT)} FROM l")
def latent_imputed(spark, d):
    return latent_rows(spark, d).select("model", "domain", "method", "query_id", *[F.round(c, 6).alias(c) for c in LATENT])


@query("SELECT vec_id, round(list_avg(list_transform(embedding[-3:], lambda x : CAST(x AS DOUBLE))), 6) AS confidence, CAST(len(list_filter(embedding, lambda x : x <> 0)) AS INTEGER) AS kept, round(coalesce(list_avg(list_transform(list_filter(embedding, lambda x : x <> 0), lambda x : greatest(-8.0, least(0.0, CAST(x AS DOUBLE))))), 0.0), 6) AS masked_mean FROM embeddings")
def score_arrays(spark, d):
    e = read(spark, d, "embeddings").withColumn("m", values.mask_padding(F.col("embedding")))
    mean = F.aggregate("m", F.lit(0.0), lambda s, x: s + x) / F.size("m")
    return e.select("vec_id", F.round(values.confidence(F.col("embedding")), 6).alias("confidence"), F.size("m").alias("kept"), F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("masked_mean"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) AS cosine, round(degrees(acos(greatest(-1.0, least(1.0, list_cosine_similarity(a.v, b.v))))), 3) AS angle FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_angles(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 5).alias("cosine"), F.round(vectors.angle(F.col("embedding"), F.col("b")), 3).alias("angle"))


@query(f"WITH {_ANG}, st AS (SELECT domain, model, method, avg(angle) / stddev_samp(angle) AS cd FROM an GROUP BY ALL) SELECT domain, model, method, CASE WHEN abs(cd) >= 0.8 THEN 'large' WHEN abs(cd) >= 0.5 THEN 'medium' ELSE 'small' END AS d_size FROM st")
def effect_labels(spark, d):
    s = _angles(spark, d).groupBy("domain", "model", "method").agg((F.avg("angle") / F.stddev_samp("angle")).alias("cd"))
    return s.select("domain", "model", "method", values.effect_size(F.col("cd")).alias("d_size"))


@query(f"WITH {_G} SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM t) GROUP BY p")
def triple_dedup(spark, d):
    return graph(spark, d).dropDuplicates(["s", "p", "o"]).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def windowed_events(spark, d):
    """The batch form of the streaming operator: tumbling day windows by kind of event."""
    from ..streaming.resume import windowed_metrics

    w = windowed_metrics(read(spark, d, "events"), "ts", ["event_type"], "value")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 4).alias("mean"))


from . import question_queries, report_queries  # noqa: E402, F401  (register their queries)
