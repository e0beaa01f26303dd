"""Queries of report tables, provider paths and the edges of ingestion, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import providers, questions, values, vectors
from ..operators import harness, latent, pairing, profiles, stats, triples
from . import queries as Q
from .queries import FORMAL_SQL, LONG_SQL, METRIC_NAMES, ORACLE, QUESTION_SQL, query, read
from .rules import SURFACES

# ---- questions -------------------------------------------------------------------------------------------------------------------

_SYLL = "greatest(1, len(regexp_extract_all(regexp_replace(x, '([^aeiouy])e$', '\\1'), '[aeiouy]+')))"
READ_SQL = f"""{QUESTION_SQL}, rd0 AS (SELECT *, list_transform(w, lambda x : {_SYLL}) AS s, len(w) AS nw, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\\s|$)'))) AS sents FROM q),
rd1 AS (SELECT *, CAST(nw AS DOUBLE) / sents AS wps, CAST(list_sum(s) AS DOUBLE) / nullif(nw, 0) AS spw, len(list_filter(s, lambda x : x >= 3)) AS hard FROM rd0),
rd AS (SELECT *, CASE WHEN nw > 0 THEN round(206.835 - 1.015 * wps - 84.6 * spw, 2) END AS flesch_ease, CASE WHEN nw > 0 THEN round(0.39 * wps + 11.8 * spw - 15.59, 2) END AS fk_grade,
 CASE WHEN nw > 0 THEN round(0.4 * (wps + 100.0 * hard / nw), 2) END AS gunning_fog, CASE WHEN nw > 0 THEN round(1.043 * sqrt(hard * (30.0 / sents)) + 3.1291, 2) END AS smog FROM rd1)"""
ORACLE["readability"] = f"WITH {READ_SQL} SELECT example_id, domain, flesch_ease, fk_grade, gunning_fog, smog FROM rd"

_ALL16 = [*Q.SURFACE_NAMES, *questions.FLAGS, "has_question_mark", "flesch_ease", "gunning_fog", "fk_grade"]


@query(f"WITH {READ_SQL} SELECT domain, count(*) AS n, {', '.join(f'round(avg({c}), 3) AS {c}_mean, round(median(CAST({c} AS DOUBLE)), 3) AS {c}_median, round(stddev_samp({c}), 3) AS {c}_std' for c in _ALL16)} FROM rd GROUP BY domain")
def surface_summary_all(spark, d):
    """Mean, median and deviation of all sixteen surface metrics by domain."""
    return profiles.surface_summary(questions.readability(Q.question_corpus(spark, d), "text"), _ALL16)


def _join_wide(parts: dict[str, str], key: str) -> str:
    first, *rest = parts
    return " ".join([f"{first}", *[f"LEFT JOIN {x} USING ({key})" for x in rest]])


_DOMS = ("FiQA", "LegalQA", "TelcoQA")
_PAIRS = [(a, b) for i, a in enumerate(_DOMS) for b in _DOMS[i + 1 :]]


def stats_wide(spark, d, names, corpus):
    """One row per metric: test, and mean, median and deviation per domain, and p and d per pair of domains."""
    f = corpus(spark, d)
    s = profiles.scalar_summary(f, names)
    wide = s.groupBy("metric").agg(*[F.max(F.when(F.col("domain") == x, F.col(c))).alias(f"{c}_{x}") for x in _DOMS for c in ("mean", "median", "std")])
    p = stats.dunn(f, names, "domain")
    pairs = p.groupBy("metric").agg(*[F.max(F.when((F.col("group_a") == a) & (F.col("group_b") == b), F.col(c))).alias(f"{c}_{a}_{b}") for a, b in _PAIRS for c in ("p_adj", "d")])
    return stats.kruskal(f, names, "domain").select("metric", "h", "p", "significant").join(wide, "metric", "left").join(pairs, "metric", "left")


_WIDE_SQL = (
    f"SELECT metric, h, p, significant, {', '.join(f'{c}_{x}' for x in _DOMS for c in ('mean', 'median', 'std'))}, {', '.join(f'{c}_{a}_{b}' for a, b in _PAIRS for c in ('p_adj', 'd'))} FROM ({{0}}) k "
    f"LEFT JOIN (SELECT metric, {', '.join(f"max({c}) FILTER (domain = '{x}') AS {c}_{x}" for x in _DOMS for c in ('mean', 'median', 'std'))} FROM ({{1}}) GROUP BY metric) s USING (metric) "
    f"LEFT JOIN (SELECT metric, {', '.join(f"max({c}) FILTER (group_a = '{a}' AND group_b = '{b}') AS {c}_{a}_{b}" for a, b in _PAIRS for c in ('p_adj', 'd'))} FROM ({{2}}) GROUP BY metric) u USING (metric)"
)


@query(_WIDE_SQL.format(ORACLE["kruskal_wallis"], ORACLE["scalar_summary"], ORACLE["dunn_pairs"]))
def stats_table(spark, d):
    return stats_wide(spark, d, METRIC_NAMES, Q.formal_once)


@query("SELECT resp_id, method, CASE WHEN n_line > 0 THEN 'line' WHEN n_word > 0 THEN 'word' END AS kind FROM (SELECT resp_id, method, CASE WHEN len(l) > 2 THEN len(list_filter(list_distinct(list_filter(t, lambda x : x <> '')), lambda x : len(list_filter(t, lambda y : y = x)) > 2)) ELSE 0 END AS n_line, "
       "len(list_filter(range(1, len(w)), lambda i : w[i] = w[i + 1])) AS n_word FROM (SELECT resp_id, method, string_split(response, chr(10)) AS l, list_transform(string_split(response, chr(10)), lambda x : regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS t, list_filter(regexp_split_to_array(response, '\\s+'), lambda x : x <> '') AS w FROM (" + Q._ANS.split("a AS (", 1)[1][:-1] + ") WHERE response IS NOT NULL)) WHERE n_line > 0 OR n_word > 0")
def repeated_lines_and_words(spark, d):
    """Responses with a line said more than twice or a word said twice in a row: the test of degenerate_flags at lower bounds, which has cases."""
    a = Q.answers(spark, d).filter("response is not null")
    return a.select("resp_id", "method", questions.degenerate(F.col("response"), lines=2, words=1).alias("kind")).filter("kind is not null")


ORACLE["degenerate_flags"] = ORACLE["repeated_lines_and_words"].replace("CASE WHEN len(l) > 2", "CASE WHEN len(l) > 10").replace("> 2)) ELSE 0", "> 10)) ELSE 0").replace("range(1, len(w)), lambda i : w[i] = w[i + 1]", "range(1, len(w) - 9), lambda i : len(list_distinct(w[i:i + 10])) = 1")

_FORMS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SURFACES.items()) + ")"
_WORD = "[\\p{L}\\p{M}\\p{N}_]"
ORACLE["entity_spans"] = f"""WITH t AS (SELECT qa_id, lower(question) AS t FROM raw_qa WHERE question IS NOT NULL),
h AS (SELECT qa_id, t, k, n, unnest(list_filter(range(1, length(t) - length(k) + 2), lambda i : t[i:i + length(k) - 1] = k)) AS i FROM t JOIN {_FORMS} v(k, n) ON contains(t, k)),
b AS (SELECT qa_id, t, CAST(i - 1 AS INTEGER) AS s, CAST(i - 1 + length(k) AS INTEGER) AS e, n FROM h WHERE NOT regexp_matches(t[i - 1:i - 1], '{_WORD}') AND NOT regexp_matches(t[i + length(k):i + length(k)], '{_WORD}'))
SELECT qa_id, s AS start, e AS "end", n AS name, regexp_matches(t[greatest(s - 19, 1):s], '\\b(?:no|not|without|never|cannot|can''t)\\b') AS negated FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.qa_id = x.qa_id AND y.e - y.s > x.e - x.s AND y.s < x.e AND x.s < y.e)"""

_BLOCK = ", ".join(f"'{w}'" for w in sorted(triples.BLOCKED))
_LINKS = ", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(triples.CONNECTIONS.items()))
_CAUSAL = r"(?i)([A-Za-z ]{3,45}?)\s+(leads?\s+to|results?\s+in|triggers?|causes?|drives?|produces?|increases?|decreases?|reduces?)\s+([A-Za-z ]{3,45})"
_VERB = "CASE regexp_extract(lower(v), '^[a-z]+') " + " ".join(f"WHEN '{k}' THEN '{n}' WHEN '{k}s' THEN '{n}'" for k, n in triples.CAUSES.items()) + " END"


def triples_sql(source: str, keys: str) -> str:
    """CTEs that end in tr (keys, subject, predicate, object, confidence, step): pattern triples of source (keys, text)."""
    k = keys
    return rf"""src AS ({source}),
se AS (SELECT {k}, unnest(sl) AS sent, unnest(range(len(sl))) AS si FROM (SELECT {k}, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sl FROM src)),
li AS (SELECT {k}, si, i, n AS pred, list_filter(regexp_split_to_array(regexp_extract(sent, '(?is)^(.*?)\b(?:' || p || ')\b(.*)$', 1), '\s+'), lambda x : x <> '') AS bw,
 list_filter(regexp_split_to_array(regexp_extract(regexp_replace(regexp_extract(sent, '(?is)^(.*?)\b(?:' || p || ')\b(.*)$', 2), '^\s+', ''), '(?s)^[^,;]*'), '\s+'), lambda x : x <> '') AS aw FROM se JOIN (VALUES {_LINKS}) v(i, p, n) ON regexp_matches(sent, '(?i)\b(?:' || p || ')\b')),
ph AS (SELECT {k}, si, i, pred, m, array_to_string(bw[-m:], ' ') AS a, array_to_string(aw[1:m], ' ') AS b FROM li, (VALUES (3), (2), (1)) w(m)),
ca AS (SELECT {k}, si, 1000 + unnest(range(len(x))) AS i, unnest(x) AS a, unnest(y) AS v, unnest(z) AS b FROM (SELECT {k}, si, regexp_extract_all(sent, '{_CAUSAL}', 1) AS x, regexp_extract_all(sent, '{_CAUSAL}', 2) AS y, regexp_extract_all(sent, '{_CAUSAL}', 3) AS z FROM se)),
wd AS (SELECT DISTINCT t, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS key FROM (SELECT a AS t FROM ph UNION ALL SELECT b FROM ph UNION ALL SELECT a FROM ca UNION ALL SELECT b FROM ca)),
fm AS (SELECT k AS f, v AS nm, i FROM (VALUES {', '.join(f"('{a}', '{b}', {j})" for j, (a, b) in enumerate(SURFACES.items()))}) u(k, v, i)),
rs AS (SELECT t, arg_min(nm, (-c, -length(f), i)) AS nm, max(c) AS c FROM (
 SELECT t, nm, f, i, 0.95 AS c FROM wd JOIN fm ON key = f UNION ALL SELECT t, nm, f, i, 0.85 FROM wd JOIN fm ON length(f) >= 4 AND contains(key, f)
 UNION ALL SELECT t, nm, f, -1000 + list_position(string_split(key, ' '), f || 's'), 0.70 FROM wd JOIN fm ON length(f) = 3 AND list_contains(string_split(key, ' '), f || 's')) z WHERE length(lower(trim(t))) >= 3 AND lower(trim(t)) NOT IN ({_BLOCK}) GROUP BY t),
na AS (SELECT {k}, si, i, max(pred) AS pred, arg_max(ra.nm, m) FILTER (ra.c IS NOT NULL) AS s, arg_max(ra.c, m) FILTER (ra.c IS NOT NULL) AS sc, arg_max(rb.nm, m) FILTER (rb.c IS NOT NULL) AS o, arg_max(rb.c, m) FILTER (rb.c IS NOT NULL) AS oc FROM ph LEFT JOIN rs ra ON ra.t = a LEFT JOIN rs rb ON rb.t = b GROUP BY {k}, si, i),
al AS (SELECT {k}, 0 AS g, si, i, s AS subject, pred AS predicate, o AS object, round((sc + oc) / 2, 3) AS confidence, 'structural' AS step FROM na WHERE s IS NOT NULL AND o IS NOT NULL
 UNION ALL SELECT {k}, 1, si, i, ra.nm, {_VERB}, rb.nm, round((ra.c + rb.c) / 2, 3), 'causal' FROM ca JOIN rs ra ON ra.t = a JOIN rs rb ON rb.t = b),
tr AS (SELECT {k}, subject, predicate, object, CAST(confidence AS DOUBLE) AS confidence, step FROM (SELECT *, row_number() OVER (PARTITION BY {k}, subject, predicate, object ORDER BY g, si, i) AS rn FROM al) WHERE rn = 1)"""


_RESP_SQL = f"WITH {Q._ANS.replace('a AS (SELECT resp_id, model, domain,', 'a AS (SELECT resp_id, model, domain, query_id,')}"
_RESP_TR = triples_sql("SELECT resp_id, method, response AS text FROM a WHERE response IS NOT NULL", "resp_id, method")
_DENS = r"round(coalesce(typed / nullif(CAST(len(list_filter(regexp_split_to_array(response, '\s+'), lambda x : x <> '')) AS DOUBLE), 0), 0.0), 4)"
ORACLE["structural_triples"] = f"{_RESP_SQL}, {_RESP_TR} SELECT * FROM tr"
ORACLE["kd_metrics"] = f"{_RESP_SQL}, {_RESP_TR}, n AS (SELECT resp_id, method, count(*) AS n_triples, count(*) FILTER (confidence >= 0.75) AS typed FROM tr GROUP BY ALL) SELECT resp_id, model, method, coalesce(n_triples, 0) AS n_triples, coalesce(typed, 0) AS typed, {_DENS.replace('typed', 'coalesce(typed, 0)')} AS kd FROM a LEFT JOIN n USING (resp_id, method) WHERE response IS NOT NULL"

# ---- paired evaluation -------------------------------------------------------------------------------------------------------------

_WT = f"({ORACLE['win_rate_table']}) t LEFT JOIN (SELECT domain, model, {', '.join(f"max(p) FILTER (method = '{c}') AS p_{c}" for c in values.CHALLENGERS)} FROM ({ORACLE['wilcoxon_signed_rank']}) GROUP BY ALL) w USING (domain, model)"


@query(f"SELECT domain, model, best, delta_best, {', '.join(f'wr_{c}' for c in values.CHALLENGERS)}, {', '.join(f'round(p_{c}, 4) AS p_{c}' for c in values.CHALLENGERS)} FROM {_WT}")
def win_rate_tests(spark, d):
    """The win-rate table with the signed-rank test of each challenger, by the normal approximation, as its SQL has it."""
    p = pairing.aligned(Q.long_metrics(spark, d), "kd", log=True)
    t = pairing.with_tests(pairing.win_rates(p), p, most_exact=0)
    return t.select("domain", "model", "best", "delta_best", *[f"wr_{c}" for c in values.CHALLENGERS], *[F.round(f"p_{c}", 4).alias(f"p_{c}") for c in values.CHALLENGERS])


@query(f"SELECT model, arg_min(best, domain) FILTER (best IS NOT NULL) AS best, arg_min(delta_best, domain) FILTER (best IS NOT NULL) AS delta_best, round(min(least({', '.join(f'p_{c}' for c in values.CHALLENGERS)})), 4) AS p_min FROM {_WT} GROUP BY model")
def best_over_domains(spark, d):
    p = pairing.aligned(Q.long_metrics(spark, d), "kd", log=True)
    return pairing.best_over_domains(pairing.with_tests(pairing.win_rates(p), p, most_exact=0)).withColumn("p_min", F.round("p_min", 4))


_W3 = ", ".join(f"max(recall_win_rate) FILTER (method = '{c}') AS {c}" for c in values.CHALLENGERS)
_S, _C1, _C2 = values.CHALLENGERS


@query(f"SELECT domain, {', '.join(f'round(avg({c}), 4) AS {c}' for c in values.CHALLENGERS)}, round(avg({_S} - {_C1}), 4) AS adv_1, round(avg({_S} - {_C2}), 4) AS adv_2 FROM (SELECT domain, model, {_W3} FROM ({ORACLE['delta_cr_recall_wins']}) GROUP BY domain, model) GROUP BY domain")
def rate_footer(spark, d):
    return pairing.rate_footer(pairing.delta_on_wins(Q.long_metrics(spark, d)))


@query(f"SELECT method, {', '.join(f"round(round(avg(recall_win_rate) FILTER (domain = '{x}'), 8), 2) AS \"{x}\"" for x in _DOMS)} FROM ({ORACLE['delta_cr_recall_wins']}) GROUP BY method")
def domain_means(spark, d):
    return pairing.domain_means(pairing.delta_on_wins(Q.long_metrics(spark, d)), list(_DOMS))


_F = Q._FIN.format("kd")


@query(f"WITH {LONG_SQL}, x AS (SELECT model, domain, method, {_F} AS v FROM m WHERE method <> 'nlq' UNION ALL SELECT model, domain, method, min({_F}) FROM m WHERE method = 'nlq' GROUP BY ALL) SELECT method, count(v) AS n, min(v) AS low, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.75) AS q3, max(v) AS high, coalesce(max(v) / min(v) FILTER (v > 0) > 20, false) AS log_scale FROM x GROUP BY method")
def box_stats_once(spark, d):
    """Box-plot figures in which the baseline counts once per model and domain."""
    return pairing.box_stats(Q.long_metrics(spark, d), "kd", baseline_once=("model", "domain"))


@query(f"SELECT domain, model, method, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN p < 0.001 THEN '+' WHEN p < 0.05 THEN '*' ELSE '' END AS marks FROM (SELECT domain, model, method, round(p, 4) AS p FROM ({ORACLE['wilcoxon_signed_rank']}))")
def significance_labels(spark, d):
    w = Q.wilcoxon_signed_rank(spark, d).select("domain", "model", "method", F.round("p", 4).alias("p"))
    return w.withColumns({"stars": values.significance(F.col("p")), "marks": values.significance(F.col("p"), "marks")})


@query(f"SELECT domain, -h AS low, h AS high FROM (SELECT domain, round(coalesce(max(greatest(abs(mean - std), abs(mean + std))) * 1.22 + 3, 30.0), 2) AS h FROM ({ORACLE['angle_stats']}) GROUP BY domain)")
def plot_limits(spark, d):
    """Symmetric axis limits by domain, from mean angles give or take a deviation."""
    s = Q.angle_stats(spark, d).select("domain", (F.col("mean") - F.col("std")).alias("lo"), (F.col("mean") + F.col("std")).alias("hi"))
    return latent.plot_limits(s).select("domain", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


# ---- provider paths ----------------------------------------------------------------------------------------------------------------

_CLAIM_SQL = f"WITH {Q._ANS}, s AS (SELECT resp_id, method, unnest(list_transform(string_split(regexp_replace(response, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x : regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS c FROM a WHERE response IS NOT NULL), k AS (SELECT resp_id, method, c FROM s WHERE len(regexp_extract_all(c, '\\S+')) >= 5)"


@query(f"{_CLAIM_SQL} SELECT resp_id, method, count(*) AS n_claims, count(*) FILTER (length(c) % 3 = 0) AS n_entailed, round(count(*) FILTER (length(c) % 3 = 0) / count(*), 4) AS claim_recall FROM k GROUP BY ALL")
def claim_recall(spark, d):
    """Share of entailed claims of each response, with labels of a stub scorer: entailed are claims of a length divisible by three."""
    a = Q.answers(spark, d).filter("response is not null").select("resp_id", "method", F.explode(questions.claims(F.col("response"))).alias("c"))
    score = F.when(F.length("c") % 3 == 0, 0.9).otherwise(0.1)
    labels = F.array(F.struct(F.lit("contradiction").alias("label"), F.lit(0.05).alias("score")), F.struct(F.lit("entailment").alias("label"), score.alias("score")), F.struct(F.lit("neutral").alias("label"), F.lit(0.4).alias("score")))
    return providers.claim_recall(a.withColumns({"labels": labels, "reference": F.lit("a reference")}), ["resp_id", "method"])


_TOK = lambda c: "[" + ", ".join(f"list_transform({c}[{8 * i + 1}:{8 * i + 8}], lambda x : CAST(x AS DOUBLE))" for i in range(8)) + "]"


@query(f"WITH e AS (SELECT vec_id, {_TOK('embedding')} AS t FROM embeddings) SELECT a.vec_id, round(list_avg(list_transform(b.t, lambda r : list_max(list_transform(a.t, lambda c : list_cosine_similarity(r, c))))), 5) AS recall FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def token_recall(spark, d):
    """Recall by greedy alignment of token vectors: every embedding is read as eight tokens, the next one is its reference."""
    tok = F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(8)])
    e = read(spark, d, "embeddings").select("vec_id", tok.alias("t"))
    ref = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("r"))
    return e.join(ref, "vec_id").select("vec_id", F.round(vectors.alignment_recall(F.col("r"), F.col("t")), 5).alias("recall"))


# ---- edges -------------------------------------------------------------------------------------------------------------------------


@query()
def normalised_answers(spark, d):
    """Reference answers in compatibility form; SQL has no such normal form, the tests have worked texts."""
    return read(spark, d, "raw_qa").select("qa_id", questions.normalised(F.col("ground_truth")).alias("text"))


@query("SELECT qa_id, len(list_filter(list_transform(string_split(regexp_replace(ground_truth, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x : regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x : x <> '')) AS n_pieces FROM raw_qa WHERE ground_truth IS NOT NULL")
def sentence_pieces(spark, d):
    return read(spark, d, "raw_qa").filter("ground_truth is not null").select("qa_id", F.size(questions.sentence_split(F.col("ground_truth"))).cast("bigint").alias("n_pieces"))


@query("SELECT DISTINCT domain || '_' || replace(model, '-', '_') AS sheet, domain, array_to_string(list_transform(regexp_extract_all(replace(model, '-', '_'), '[a-z]+|[^a-z]+'), lambda w : upper(w[1]) || w[2:]), '') AS model FROM all_models_responses WHERE model IS NOT NULL AND domain IS NOT NULL")
def sheet_names(spark, d):
    """Domain and model of tables named domain_model."""
    r = read(spark, d, "all_models_responses").filter("model is not null and domain is not null").select(F.concat_ws("_", "domain", F.replace("model", F.lit("-"), F.lit("_"))).alias("sheet")).distinct()
    return r.select("sheet", values.domain_of_name(F.col("sheet")).alias("x")).select("sheet", "x.*")


@query("SELECT resp_id, substring(question, 1, 120) AS question, substring(nlq_response, 1, 150) AS nlq_response FROM all_models_responses")
def report_texts(spark, d):
    return read(spark, d, "all_models_responses").select("resp_id", *values.cut({"question": 120, "nlq_response": 150}))


@query(f"WITH {LONG_SQL}, e AS (SELECT *, CASE WHEN starts_with(method, 'sparql') THEN ' Rule_Based ' ELSE 'general' END AS ext FROM m) SELECT model, count(*) AS n FROM e WHERE lower(trim(ext)) = 'rule_based' GROUP BY model")
def extractor_rows(spark, d):
    m = Q.long_metrics(spark, d).withColumn("ext", F.when(F.startswith("method", F.lit("sparql")), " Rule_Based ").otherwise("general"))
    return m.filter(values.of_extractor("ext")).groupBy("model").agg(F.count("*").alias("n"))


@query("SELECT resp_id, CASE WHEN trim(coalesce(sparql_query, ''), ' ') = '' THEN 'ERROR: empty source for mode sparql' ELSE sparql_response END AS response FROM all_models_responses")
def guarded_responses(spark, d):
    """Responses of the formal mode, with an error record where the formal query is missing."""
    r = read(spark, d, "all_models_responses")
    return harness.guarded(r, F.col("sparql_query"), F.lit("sparql"), "sparql_response").select("resp_id", F.col("sparql_response").alias("response"))




@query("WITH k AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM model_config), t AS (SELECT unnest(range(8)) AS i, unnest([" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in harness.CHAT_TEMPLATES.values()) + "]) AS template) SELECT r.resp_id, replace(t.template, '{prompt}', coalesce(r.question, '')) AS wrapped FROM all_models_responses r JOIN k ON k.name = r.model JOIN t USING (i)")
def templated_prompts(spark, d):
    """Questions in the chat templates of their models; the models of the table take the templates in order of their names."""
    names = [r["name"] for r in read(spark, d, "model_config").select("name").orderBy("name").collect()]  # six rows
    t = spark.createDataFrame(list(zip(names, harness.CHAT_TEMPLATES.values())), "model string, template string")
    r = read(spark, d, "all_models_responses").select("resp_id", "model", F.coalesce("question", F.lit("")).alias("question")).join(t.select("model"), "model", "left_semi")
    return harness.wrapped(r, t, "model", "question").select("resp_id", "wrapped")


@query("SELECT qa_id, coalesce(nullif(trim(institute, ' '), ''), CAST(row_number() OVER (ORDER BY qa_id) AS VARCHAR)) AS key FROM raw_qa")
def numbered_rows(spark, d):
    """A key from a column with gaps (the institute): the row's number where it is missing."""
    return triples.numbered(read(spark, d, "raw_qa").select("qa_id", "institute"), "institute", ["qa_id"], "key", buckets=32).select("qa_id", "key")


def _gold(spark, d):
    from ..functions.values import query_number

    q = read(spark, d, "raw_qa").withColumn("query_number", query_number(F.col("query_id")))
    g = harness.last_truth(q, "query_number", "ground_truth", "loaded_at", "")
    return triples.extract(g.filter("query_number is not null"), ["query_number"], "ground_truth", SURFACES).withColumnRenamed("query_number", "query_id")


_GOLD = f"gl AS (SELECT query_number AS query_id, CASE WHEN ground_truth = '[EMPTY]' THEN '' ELSE ground_truth END AS text FROM ({ORACLE['last_ground_truth']}) WHERE query_number IS NOT NULL)"


@query(f"WITH {_GOLD}, {triples_sql('SELECT query_id, text FROM gl', 'query_id')} SELECT * FROM tr")
def gold_triples(spark, d):
    """Distinct triples of the reference answers, each once per query."""
    return _gold(spark, d).dropDuplicates(["query_id", "subject", "predicate", "object"])


@query(f"{_RESP_SQL}, {_RESP_TR}, n AS (SELECT resp_id, method, count(*) AS c, count(*) FILTER (confidence >= 0.75) AS typed FROM tr GROUP BY ALL), g AS (SELECT query_id, count(*) AS g FROM ({ORACLE['gold_triples']}) GROUP BY query_id), "
       f"x AS (SELECT a.*, coalesce(c, 0) AS c, coalesce(typed, 0) AS typed, coalesce(g, 0) AS g, coalesce(lower(trim(response, ' ')) IN ('', 'nan', 'none', 'n/a'), true) AS missing FROM a LEFT JOIN n USING (resp_id, method) LEFT JOIN g ON g.query_id = a.query_id) "
       f"SELECT resp_id, query_id, method, CASE WHEN missing THEN 0 ELSE c END AS triple_count_c, g AS triple_count_g, round(CASE WHEN missing THEN 0 ELSE c END / nullif(CAST(g AS DOUBLE), 0), 4) AS ratio_c_over_g, CASE WHEN missing THEN 0.0 ELSE {_DENS} END AS kd, missing FROM x")
def triple_counts(spark, d):
    """Per response: triples found, triples of its reference, their ratio and typed triples per word."""
    a = Q.answers(spark, d)
    t = triples.extract(a.filter("response is not null"), ["resp_id", "method"], "response", SURFACES)
    return triples.density_by_method(a, ["resp_id"], "method", "response", t, _gold(spark, d), "query_id")
