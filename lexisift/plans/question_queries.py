"""Queries of the question transformer and of annotated texts, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import builders, parsed, transform, triples
from . import rules as R
from .queries import query, read

DOMAINS = {"FiQA": "finance", "LegalQA": "legal", "TelcoQA": "telco"}

_Q = lambda s: s.replace("'", "''")
FOLD = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '[^\\x{{00}}-\\x{{7F}}\\p{{P}}\\p{{S}}\\p{{Z}}]', 'x', 'g')"
QS = f"q AS (SELECT qa_id, domain, question, document, {FOLD.format('question')} AS t, {FOLD.format('document')} AS d FROM raw_qa)"


def questions(spark, d) -> DataFrame:
    q = read(spark, d, "raw_qa").select("qa_id", "domain", "question", "document")
    return q.withColumns({"t": transform.folded(F.col("question")), "d": transform.folded(F.col("document"))})


def _case(rules, default: str | None, t: str = "t") -> str:
    other = "NULL" if default is None else f"'{_Q(default)}'"
    return f"CASE WHEN {t} IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches({t}, '{_Q(p)}') THEN '{_Q(n)}'" for n, p in rules) + f" ELSE {other} END"


def _of_domain(make) -> str:
    return "CASE domain " + " ".join(f"WHEN '{k}' THEN {make(v)}" for k, v in DOMAINS.items()) + " END"


def _by_domain(make):
    out = F.lit(None).cast("string")
    for k, v in DOMAINS.items():
        out = F.when(F.col("domain") == k, make(v)).otherwise(out)
    return out


def _form(v):
    return transform.first_label(F.col("t"), R.QUESTION_FORMS[v], R.FORM_DEFAULT[v])


def _intent(v):
    return transform.first_label(F.col("t"), R.INTENTS[v], R.INTENT_DEFAULT[v])


_FORM_SQL = _of_domain(lambda v: _case(R.QUESTION_FORMS[v], R.FORM_DEFAULT[v]))
_INTENT_SQL = _of_domain(lambda v: _case(R.INTENTS[v], R.INTENT_DEFAULT[v]))
_FI_TYPE = _case(R.QUERY_TYPES["finance"], R.QUERY_TYPE_DEFAULT["finance"])
_LEGAL_TYPE = f"(CASE WHEN l = 'Legislation' AND regexp_matches(question, '{R.CASE_CITED}') AND regexp_matches(t, 'in\\s+the\\s+case\\s+of') THEN 'CaseLaw' ELSE l END)"


@query(f"WITH {QS}, w AS (SELECT *, {_case(R.QUERY_TYPES['legal'], R.QUERY_TYPE_DEFAULT['legal'])} AS l FROM q) SELECT qa_id, {_FORM_SQL} AS q_type, {_INTENT_SQL} AS intent, {_FI_TYPE} AS finance_type, {_LEGAL_TYPE} AS legal_type, {_case(R.PROPERTY_CATEGORIES, R.CATEGORY_DEFAULT)} AS category FROM w")
def question_classes(spark, d):
    """Question type and intent by the rules of the question's domain, query types of two domains and property category of each question."""
    q = questions(spark, d)
    legal = transform.legal_query_type(F.col("question"), F.col("t"), R.QUERY_TYPES["legal"], R.QUERY_TYPE_DEFAULT["legal"], R.CASE_CITED)
    return q.select(
        "qa_id", _by_domain(_form).alias("q_type"), _by_domain(_intent).alias("intent"), transform.first_label(F.col("t"), R.QUERY_TYPES["finance"], R.QUERY_TYPE_DEFAULT["finance"]).alias("finance_type"),
        legal.alias("legal_type"), transform.first_label(F.col("t"), R.PROPERTY_CATEGORIES, R.CATEGORY_DEFAULT).alias("category"),
    )


def _with_metadata(q: DataFrame) -> DataFrame:
    return transform.metadata(q, "question", R.METADATA)


_META_SQL = "m AS (SELECT *, " + ", ".join(f"coalesce(regexp_extract_all(question, '{_Q(p)}', 1), []) AS {k}" for k, p in R.METADATA.items()) + " FROM q)"
_INST_SQL = "CASE " + " ".join(f"WHEN regexp_matches(concat_ws(' ', coalesce(t, ''), d), '{_Q(p)}') THEN '{n}'" for n, p in R.INSTITUTES) + f" ELSE '{R.INSTITUTE_DEFAULT}' END"
_NUMBERS_SQL = "CASE list_filter(doc_numbers, lambda x : x IN (" + ", ".join(f"'{n}'" for n in R.DOCUMENT_NUMBERS) + "))[1] " + " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in R.DOCUMENT_NUMBERS.items()) + " END"
_DOC_SQL = "CASE institute " + " ".join(f"WHEN '{n}' THEN " + (f"coalesce({_NUMBERS_SQL}, {_case(r, '')}, '')" if n == R.INSTITUTE_DEFAULT else f"coalesce({_case(r, '')}, '')") for n, r in R.DOCUMENTS.items()) + " ELSE '' END"
_COURT_SQL = "CASE lower(regexp_extract(question, '\\[\\d{4}\\]\\s*([A-Za-z]+)\\s*\\d+', 1)) " + " ".join(f"WHEN '{c}' THEN '{j}'" for j, cs in R.COURTS.items() for c in cs.split()) + " END"
_JUR_SQL = f"CASE WHEN question IS NOT NULL THEN coalesce({_case([(k, p) for p, k in R.PLACES], None)}, {_COURT_SQL}, {_case(R.JURISDICTION_WORDS, 'federal')}) END"
_LAND_SQL = "coalesce(" + " OR ".join(f"contains(t, '{w}')" for w in R.LANDLINE_WORDS) + ", false)"


def context(q: DataFrame) -> DataFrame:
    """q with metadata, institute, document, jurisdiction and landline."""
    m = _with_metadata(q).withColumn("institute", transform.institute(F.col("t"), F.col("d"), R.INSTITUTES, R.INSTITUTE_DEFAULT))
    return m.withColumns(
        {
            "document": transform.document(F.col("t"), F.col("institute"), R.DOCUMENTS, F.col("doc_numbers"), R.DOCUMENT_NUMBERS),
            "jurisdiction": transform.jurisdiction(F.col("question"), F.col("t"), R.PLACES, R.COURTS, R.JURISDICTION_WORDS, "federal"),
            "landline": transform.mentions(F.col("t"), R.LANDLINE_WORDS),
        }
    )


@query(f"WITH {QS}, {_META_SQL}, i AS (SELECT *, {_INST_SQL} AS institute FROM m) SELECT qa_id, institute, {_DOC_SQL} AS document, {_JUR_SQL} AS jurisdiction, {_LAND_SQL} AS landline, {', '.join(f"array_to_string({k}, '|') AS {k}" for k in R.METADATA)} FROM i")
def question_context(spark, d):
    """Institute, document, jurisdiction and metadata of each question."""
    c = context(questions(spark, d))
    return c.select("qa_id", "institute", "document", "jurisdiction", "landline", *[F.concat_ws("|", k).alias(k) for k in R.METADATA])


_SCORE = lambda f: "(" + " + ".join([f"CASE WHEN regexp_matches(t, '{w}') THEN 2 ELSE 0 END" for w in R.FIELD_WORDS.get(f, ())] or ["0"]) + ")"
_FIELDS_SQL = "CASE " + _FI_TYPE + " " + " ".join(f"WHEN '{k}' THEN list_concat(['{v[0]}'], list_transform(list_reverse_sort([{', '.join(f'{{score: {_SCORE(f)}, name: {chr(39)}{f}{chr(39)}}}' for f in v[1:])}])[1:2], lambda x : x.name))" for k, v in R.FIELDS.items()) + " END"
_CATF_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in R.CATEGORY_FIELDS) + "], lambda x : x IS NOT NULL)"
_CATD_SQL = f"CASE {_case(R.PROPERTY_CATEGORIES, R.CATEGORY_DEFAULT)} " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in R.CATEGORY_FIELD_DEFAULTS.items()) + f" ELSE [{', '.join(repr(x) for x in R.CATEGORY_FIELD_OTHER)}] END"


@query(f"WITH {QS}, c AS (SELECT qa_id, {_FIELDS_SQL} AS f, {_CATF_SQL} AS g, {_CATD_SQL} AS h FROM q WHERE t IS NOT NULL) SELECT qa_id, array_to_string(f, '|') AS fields, array_to_string(CASE WHEN len(g) > 0 THEN g ELSE h END, '|') AS category_fields FROM c")
def question_fields(spark, d):
    """Projected fields of each question by query type and by property category."""
    q = questions(spark, d).filter("t is not null")
    kind = transform.first_label(F.col("t"), R.QUERY_TYPES["finance"], R.QUERY_TYPE_DEFAULT["finance"])
    category = transform.first_label(F.col("t"), R.PROPERTY_CATEGORIES, R.CATEGORY_DEFAULT)
    q = q.withColumns({"k": kind, "c": category})
    return q.select("qa_id", F.concat_ws("|", transform.projected_fields(F.col("k"), F.col("t"), R.FIELDS, R.FIELD_WORDS)).alias("fields"), F.concat_ws("|", transform.category_fields(F.col("t"), F.col("c"), R.CATEGORY_FIELDS, R.CATEGORY_FIELD_DEFAULTS, R.CATEGORY_FIELD_OTHER)).alias("category_fields"))


def _vocabulary_sql(voc: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{_Q(k)}', '{v}')" for i, (k, v) in enumerate(sorted(voc.items(), key=lambda kv: -len(kv[0])))) + ")"


_FOUND = {"hasSection": "sections", "hasDays": "days", "hasPercentage": "percents"}


@query(
    f"WITH {QS}, {_META_SQL}, h AS (SELECT qa_id, i, k AS surface, n AS name, nullif(regexp_extract(t, k || '[\\s:=]+([\\w.\\-#%]+)', 1), '') AS value FROM m JOIN {_vocabulary_sql(R.DATA_PROPERTIES)} v(i, k, n) ON contains(t, k) "
    + "".join(f" UNION ALL SELECT qa_id, {100 + j}, {c}[1], '{n}', {c}[1] FROM m WHERE len({c}) > 0" for j, (n, c) in enumerate(_FOUND.items()))
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY qa_id, name ORDER BY i) AS k FROM h) SELECT qa_id, surface, name, value FROM r WHERE k = 1"
)
def question_properties(spark, d):
    """Data properties of each question with their values."""
    m = _with_metadata(questions(spark, d))
    p = transform.data_properties(F.col("t"), R.DATA_PROPERTIES, {n: F.col(c) for n, c in _FOUND.items()})
    return m.select("qa_id", F.explode(p).alias("p")).select("qa_id", "p.*")


@query(
    f"WITH {QS} SELECT qa_id, k AS surface, n AS name, regexp_matches(substring(t, greatest(instr(t, k) - 25, 1), least(instr(t, k) - 1, 25)), '{_Q(transform.NEGATED)}') AS negated FROM q JOIN {_vocabulary_sql(R.RELATIONS)} v(i, k, n) ON contains(t, k)"
)
def question_relations(spark, d):
    """Surface relations of each question with their negation."""
    return questions(spark, d).select("qa_id", F.explode(transform.surface_relations(F.col("t"), R.RELATIONS)).alias("r")).select("qa_id", "r.*")


_ENT_SQL = (
    f"e0 AS (SELECT qa_id, t, k AS surface, n AS name, length(regexp_extract(t, '(?s)^(.*?)(?:^|[^\\w])' || k || '(?:[^\\w]|$)', 1)) AS first FROM q JOIN {_vocabulary_sql(R.SURFACES)} v(i, k, n) ON regexp_matches(t, '(?:^|[^\\w])' || k || '(?:[^\\w]|$)')), "
    "e AS (SELECT qa_id, surface, name, first, regexp_matches(substring(t, greatest(first + 1 - 20, 1), least(20, first + 1)), '\\b(?:no|not|without|never|cannot|can''t)\\b') AS negated FROM e0 a "
    "WHERE NOT EXISTS (SELECT 1 FROM e0 b WHERE b.qa_id = a.qa_id AND length(b.surface) > length(a.surface) AND contains(b.surface, a.surface) AND abs(b.first - a.first) <= length(b.surface)))"
)


@query(f"WITH {QS}, {_ENT_SQL} SELECT qa_id, surface, name, CAST(first AS INTEGER) AS first, negated FROM e")
def question_entities(spark, d):
    """Entities of each question by their surfaces."""
    return questions(spark, d).select("qa_id", F.explode(transform.entities_by_surface(F.col("t"), R.SURFACES)).alias("e")).select("qa_id", "e.*")


_ANY = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
_STATUS_SQL = "list_filter([" + ", ".join(
    [f"CASE WHEN contains(t, '{s}') AND contains(t, '{c}') THEN 'light:{s}_{c}' END" for s in R.LIGHTS for c in R.COLOURS] + [f"CASE WHEN contains(t, '{s}') AND NOT {_ANY(R.COLOURS)} THEN 'light_status:{s}' END" for s in R.LIGHTS] + [f"CASE WHEN contains(t, '{c}') AND NOT {_ANY(R.LIGHTS)} THEN 'color:{c}' END" for c in R.COLOURS]
) + "], lambda x : x IS NOT NULL)"
_ACTIONS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in R.ACTIONS) + "], lambda x : x IS NOT NULL)"


@query(f"WITH {QS} SELECT qa_id, array_to_string({_STATUS_SQL}, '|') AS statuses, array_to_string({_ACTIONS_SQL}, '|') AS actions FROM q WHERE t IS NOT NULL")
def question_signals(spark, d):
    """Status lights and service actions that a question names."""
    q = questions(spark, d).filter("t is not null")
    return q.select("qa_id", F.concat_ws("|", transform.status_indicators(F.col("t"), R.LIGHTS, R.COLOURS)).alias("statuses"), F.concat_ws("|", transform.labels_found(F.col("t"), R.ACTIONS)).alias("actions"))


def _focus_sql(v: str) -> str:
    case = lambda k, m: "CASE " + k + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in m.items()) + " END" if m else "NULL"
    default = "coalesce('?' || lower(n1[1]) || n1[2:], '?answer')" if v == "telco" else f"'{R.FOCUS_DEFAULT[v]}'"
    return f"CASE WHEN q_type IN ('POLAR', 'EXISTENCE') THEN '' ELSE coalesce({case('q_type', R.FOCUS_BY_FORM[v])}, {case('intent', R.FOCUS_BY_INTENT[v])}, {default}) END"


_LF_SQL = f"""{QS}, {_ENT_SQL}, g AS (SELECT qa_id, list(name ORDER BY first) AS names, list(surface ORDER BY first) AS surfaces FROM e GROUP BY qa_id),
c AS (SELECT q.*, coalesce(names, []) AS names, coalesce(surfaces, []) AS surfaces, names[1] AS n1, names[2] AS n2, {_FORM_SQL} AS q_type, {_INTENT_SQL} AS intent FROM q LEFT JOIN g USING (qa_id) WHERE t IS NOT NULL)"""


def forms(q: DataFrame, v: str, spo: str | None = None) -> DataFrame:
    """Logical forms of questions by the rules of a domain."""
    return transform.logical_form(q, "t", _form(v), _intent(v), R.SURFACES, R.RELATIONS, R.DATA_PROPERTIES, R.FOCUS_BY_FORM[v], R.FOCUS_BY_INTENT[v], R.FOCUS_DEFAULT[v], {n: F.col(c) for n, c in _FOUND.items()}, spo)


def _forms(spark, d) -> DataFrame:
    q = _with_metadata(questions(spark, d)).filter("t is not null")
    parts = [forms(q.filter(F.col("domain") == k), v) for k, v in DOMAINS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"WITH {_LF_SQL} SELECT qa_id, q_type, intent, {_of_domain(_focus_sql)} AS focus, CASE WHEN regexp_matches(t, '\\ball\\b|\\bevery\\b|\\beach\\b') THEN 'universal' ELSE 'existential' END AS quantifier, array_to_string(names, '|') AS entities, "
    "CAST(greatest(len(names) - 2, 0) AS INTEGER) AS n_nary, CAST(CASE WHEN contains(t, ' or ') THEN len(list_filter(string_split(t, ' or '), lambda p : len(list_filter(surfaces, lambda s : contains(p, s))) > 0)) ELSE 0 END AS INTEGER) AS n_groups FROM c WHERE domain IN ('FiQA', 'LegalQA', 'TelcoQA')"
)
def logical_forms(spark, d):
    """Logical form of each question: type, intent, focus, quantifier, entities, n-ary arguments and groups around 'or'."""
    f = _forms(spark, d)
    return f.select("qa_id", "q_type", "intent", "focus", "quantifier", F.concat_ws("|", F.transform("entities", lambda e: e["name"])).alias("entities"), F.size("nary").alias("n_nary"), F.size("groups").alias("n_groups"))


_REL_SQL = f"r AS (SELECT qa_id, i, n, regexp_matches(substring(t, greatest(instr(t, k) - 25, 1), least(instr(t, k) - 1, 25)), '{_Q(transform.NEGATED)}') AS negated FROM q JOIN {_vocabulary_sql(R.RELATIONS)} v(i, k, n) ON contains(t, k))"
_VAR = "'?' || lower({0}[1]) || {0}[2:]"


@query(
    f"WITH {_LF_SQL}, {_REL_SQL}, v AS (SELECT qa_id, coalesce({_VAR.format('n1')}, '?subject') AS s, coalesce({_VAR.format('n2')}, '?object') AS o, len(names) AS k FROM c), "
    "x AS (SELECT v.qa_id, CASE WHEN r.negated THEN 'not' ELSE 'role' END AS kind, s || ' qa:' || r.n || ' ' || o AS triple FROM v JOIN r USING (qa_id) UNION ALL SELECT qa_id, 'role', s || ' qa:relatedTo ' || o FROM v WHERE k >= 2 AND qa_id NOT IN (SELECT qa_id FROM r)) SELECT qa_id, kind, triple, count(*) AS n FROM x GROUP BY ALL"
)
def described_roles(spark, d):
    """Roles of the description-logic form of each question, asserted and negated."""
    q = transform.description(forms(_with_metadata(questions(spark, d)).filter("t is not null"), "finance"), "qa", "relatedTo")
    flat = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), F.concat_ws(" ", x["s"], x["p"], x["o"]).alias("triple")))
    return q.select("qa_id", F.explode(F.concat(flat("roles", "role"), flat("not_roles", "not"))).alias("x")).groupBy("qa_id", "x.kind", "x.triple").agg(F.count("*").alias("n"))


def _built(spark, d) -> DataFrame:
    q = context(questions(spark, d)).withColumn("finance_type", transform.first_label(F.col("t"), R.QUERY_TYPES["finance"], R.QUERY_TYPE_DEFAULT["finance"]))
    q = q.withColumn("fields", transform.projected_fields(F.col("finance_type"), F.col("t"), R.FIELDS, R.FIELD_WORDS))
    f = transform.description(forms(q, "finance"), "fi", "relatedTo")
    first = lambda c: F.try_element_at(c, F.lit(1))
    extra = {"hasSection": (first("sections"), ""), "hasDays": (first("days"), "^^xsd:integer"), "hasPercentage": (first("percents"), "^^xsd:decimal")}
    return builders.fields_select(f, "question", "fi", builders.prefixes([R.SPACES["finance"]]), "?service", {"query_type": F.col("finance_type"), "institute": F.col("institute"), "document": F.col("document")}, extra, {"queryType": F.col("finance_type"), "institute": F.col("institute")})


_ESC = "replace(question, '\"', '\\\"')"
_BUILT_SQL = f"""WITH {_LF_SQL}, {_META_SQL}, {_REL_SQL}, {_INST_SQL.join(['i AS (SELECT *, ', ' AS institute FROM m)'])},
b AS (SELECT c.qa_id, c.question, c.names, {_case(R.QUESTION_FORMS['finance'], 'POLAR', 'c.t')} AS ft, {_case(R.INTENTS['finance'], 'SELECT_GENERAL', 'c.t')} AS it, i.institute, (SELECT {_DOC_SQL} FROM (SELECT i.institute, i.t, i.doc_numbers)) AS document, (SELECT {_FI_TYPE} FROM (SELECT i.t)) AS k,
 (SELECT {_FIELDS_SQL} FROM (SELECT i.t)) AS f, i.sections[1] AS sec, i.days[1] AS dy, i.percents[1] AS pc, coalesce({_VAR.format('n1')}, '?subject') AS s, coalesce({_VAR.format('n2')}, '?object') AS o,
 CASE WHEN contains(c.t, ' or ') THEN list_filter(list_transform(string_split(c.t, ' or '), lambda p : list_filter(list_zip(c.surfaces, c.names), lambda z : contains(p, z[1]))), lambda g : len(g) > 0) ELSE [] END AS grp FROM c JOIN i USING (qa_id)),
x AS (SELECT *, {_focus_sql('finance').replace('q_type', 'ft').replace('intent', 'it')} AS focus FROM b),
n AS (SELECT r.qa_id, list('FILTER NOT EXISTS {{ ' || x.s || ' fi:' || r.n || ' ' || x.o || ' . }}' ORDER BY r.i) AS nots FROM r JOIN x USING (qa_id) WHERE r.negated GROUP BY r.qa_id)
"""
_HEAD = builders.VOCABULARIES


@query(
    _BUILT_SQL
    + "SELECT qa_id, CASE WHEN trim(question, ' ') <> '' THEN '" + "\n".join(f"PREFIX {k}: <{v}>" for k, v in (R.SPACES["finance"], *_HEAD)) + "\nSELECT ' || coalesce(nullif(focus, ''), '?result') || ' ' || array_to_string(list_transform(f[2:3], lambda y : '?' || y), ' ') || ' WHERE {\n  ' || array_to_string(list_concat("
    "list_filter([CASE WHEN k <> '' THEN '?service fi:query_type \"' || k || '\" .' END, CASE WHEN institute <> '' THEN '?service fi:institute \"' || institute || '\" .' END, CASE WHEN document <> '' THEN '?service fi:document \"' || document || '\" .' END], lambda y : y IS NOT NULL), "
    f"['?service fi:description \"' || {_ESC} || '\"@en .', '?service fi:' || f[1] || ' ' || coalesce(nullif(focus, ''), '?result') || ' .'], list_transform(f[2:3], lambda y : 'OPTIONAL {{ ?service fi:' || y || ' ?' || y || ' . }}'), ".replace("{{", "{").replace("}}", "}")
    + "list_filter([CASE WHEN sec IS NOT NULL THEN 'OPTIONAL { ?service fi:hasSection \"' || sec || '\" . }' END, CASE WHEN dy IS NOT NULL THEN 'OPTIONAL { ?service fi:hasDays \"' || dy || '\"^^xsd:integer . }' END, CASE WHEN pc IS NOT NULL THEN 'OPTIONAL { ?service fi:hasPercentage \"' || pc || '\"^^xsd:decimal . }' END], lambda y : y IS NOT NULL), "
    + "coalesce(nots, []), CASE WHEN len(grp) > 0 THEN [array_to_string(list_transform(grp, lambda g : '{ ' || array_to_string(list_transform(g, lambda z : '?' || lower(z[2][1]) || z[2][2:] || ' rdf:type fi:' || z[2] || ' .'), ' ') || ' }'), '\n  UNION\n  ')] ELSE [] END, "
    + f"['OPTIONAL {{\n  _:queryMeta rdf:type fi:SPARQLQuery ;\n  rdfs:comment \"' || {_ESC} || '\"@en ;\n' || array_to_string(['  fi:intent \"' || it || '\"^^xsd:string', '  fi:questionType \"' || ft || '\"^^xsd:string', '  fi:queryType \"' || k || '\"^^xsd:string', '  fi:institute \"' || institute || '\"^^xsd:string', '  fi:focusVariable \"' || focus || '\"^^xsd:string'], ' ;\n') || ' .\n  }}']), '\n  ') || '\n}}' END AS query FROM x LEFT JOIN n USING (qa_id)".replace("{{", "{").replace("}}", "}")
)
def built_queries(spark, d):
    """Query text of each question by the field template of the finance domain."""
    return _built(spark, d).filter("t is not null").select("qa_id", "query")


@query()
def dispatched_queries(spark, d):
    """Query text of each question by the template of its intent, telco rules. Templates are compared with worked texts in the tests."""
    q = context(questions(spark, d)).withColumns({"actions": transform.labels_found(F.col("t"), R.ACTIONS), "statuses": transform.status_indicators(F.col("t"), R.LIGHTS, R.COLOURS)})
    f = transform.description(forms(q.filter("t is not null"), "telco"), "broadband", "associatedWith", statuses="statuses")
    line = F.when(F.col("landline"), F.lit("PREFIX landline: <https://example.org/landline/>"))
    return builders.dispatched(f, "question", "broadband", builders.prefixes([R.SPACES["telco"]], line)).select("qa_id", "intent", "query")


@query(f"WITH {_LF_SQL} SELECT qa_id, question, {_case(R.INTENTS['finance'], 'SELECT_GENERAL')} AS \"Intent\", {_case(R.QUESTION_FORMS['finance'], 'POLAR')} AS \"Question Type\", {_FI_TYPE} AS \"Query Type\", CASE WHEN regexp_matches(t, '\\ball\\b|\\bevery\\b|\\beach\\b') THEN 'universal' ELSE 'existential' END AS \"Quantifier\" FROM c WHERE lower(trim(question, ' ')) NOT IN ('', 'nan')")
def diagnostics_rows(spark, d):
    """The flat row of a run for each question that is not null, blank or nan; its JSON columns are left to the tests."""
    b = builders.batch(_built(spark, d), "question")
    return builders.diagnostics(b, "question", {"Intent": "intent", "Question Type": "q_type", "Query Type": "finance_type", "Quantifier": "quantifier"}, ["qa_id"])


@query()
def diagnostics_rows_full(spark, d):
    """All columns of the flat row, arrays as JSON."""
    b = builders.batch(_built(spark, d), "question")
    cols = {"Intent": "intent", "SPARQL Query": "query", "Question Type": "q_type", "Focus Variable": "focus", "Query Type": "finance_type", "Institute": "institute", "Document": "document", "Projected Fields": "fields", "Sections": "sections", "Days": "days", "Percentages": "percents", "SPO Triples": "spo", "Presuppositions": "presuppositions", "Restrictions": "restrictions", "Connective": "connective", "Negated": "negated", "Quantifier": "quantifier", "Role Assertions": "roles", "Negations": "not_roles", "N-ary Type": "nary_kind", "Class Expressions": "classes"}
    return builders.diagnostics(b, "question", cols, ["qa_id"])


# ---- annotations -----------------------------------------------------------------------------------------------------------------


def stub_parser(frame):
    """A provider that tags words by their looks: capitals are proper nouns, digits numbers, a short list of verbs verbs, all others nouns;
    every token hangs on the first verb (or first token), the one before it as its subject. It stands in for a parser in queries and tests."""
    import re

    verbs = ("keep", "provide", "need", "refuse", "handles", "ignores", "lost", "pay", "return", "decides")
    out = []
    for text in frame["question"]:
        words = re.findall(r"[A-Za-z]+|[0-9]+", text or "")
        root = next((i for i, w in enumerate(words) if w.lower() in verbs), 0)
        out.append([{"text": w, "lemma": w.lower(), "pos": "VERB" if w.lower() in verbs else "NUM" if w[0].isdigit() else "PROPN" if w[0].isupper() else "NOUN", "tag": "VBZ" if w.lower() in ("handles", "ignores", "decides") else "X", "dep": "ROOT" if i == root else "nsubj" if i == root - 1 else "dep" if i < root else "dobj", "head": root} for i, w in enumerate(words)])
    return frame.assign(tokens=out, ents=[[{"label": "CARDINAL", "surface": w} for w in re.findall("[0-9]+", t or "")] for t in frame["question"]])


def annotated(spark, d) -> DataFrame:
    return providers.annotated(questions(spark, d).select("qa_id", "domain", "question", "t"), ["question"], {"tokens": parsed.TOKENS, "ents": parsed.ENTS}, stub_parser)


_WORDS_SQL = "w AS (SELECT qa_id, domain, regexp_extract_all(coalesce(question, ''), '[A-Za-z]+|[0-9]+') AS w, len(regexp_extract_all(coalesce(question, ''), '[0-9]+')) AS ne FROM raw_qa)"
_VERBS = "('keep', 'provide', 'need', 'refuse', 'handles', 'ignores', 'lost', 'pay', 'return', 'decides')"
_SHARE = lambda test: f"round(avg(round(100.0 * len(list_filter(w, lambda x : {test})) / greatest(len(w), 1), 2)), 3)"


@query(f"WITH {_WORDS_SQL} SELECT domain, count(*) AS n, {_SHARE(f'lower(x) IN {_VERBS}')} AS mean_pos_VERB, {_SHARE("regexp_matches(x, '^[0-9]')")} AS mean_pos_NUM, round(avg(ne), 3) AS mean_ne_count, round(avg(round(ne / greatest(len(w), 1), 4)), 4) AS mean_ne_density, round(avg(CASE WHEN len(w) > 1 THEN 1 ELSE 0 END), 3) AS mean_dep_tree_depth FROM w GROUP BY domain")
def syntax_profile(spark, d):
    """Profile of parts of speech, entities and trees by domain, over the annotations of the stub parser."""
    p = parsed.syntax_profiles(parsed.syntax_features(annotated(spark, d)), "domain")
    return p.select("domain", "n", "mean_pos_VERB", "mean_pos_NUM", "mean_ne_count", "mean_ne_density", "mean_dep_tree_depth")


@query()
def annotated_relations(spark, d):
    """Relations between entities of questions over the annotations of the stub parser, with the class or property of annotated entities."""
    a = annotated(spark, d).withColumn("entities", transform.entities_by_surface(F.col("t"), R.SURFACES))
    r = parsed.question_relations(a, "entities", {"keep": "keeps", "need": "requires"})
    return r.select("qa_id", F.explode_outer("spo").alias("x"), F.size(transform.ner_map(F.col("ents"), R.ENTITY_LABELS)).alias("n_named")).select("qa_id", "x.*", "n_named")


@query()
def tree_triples(spark, d):
    """Triples of annotated questions by all five passes."""
    return parsed.tree_triples(annotated(spark, d), ["qa_id"], R.SURFACES, {"keep": "keeps"}, {"days": "hasDays"}, ("written", "faulty", "guest"), triples.BLOCKED, text="question")


@query("SELECT qa_id, 'ent:' || lower(w[i-1]) AS subject, 'rel:' || lower(v) AS predicate, count(DISTINCT lower(o)) AS n_objects FROM (SELECT qa_id, w, v, i, unnest(w[i+1:]) AS o FROM (SELECT qa_id, w, list_filter(w, lambda x : lower(x) IN " + _VERBS + ")[1] AS v, list_position(w, list_filter(w, lambda x : lower(x) IN " + _VERBS + ")[1]) AS i FROM (SELECT qa_id, regexp_extract_all(question, '[A-Za-z]+|[0-9]+') AS w FROM raw_qa)) WHERE i > 1) GROUP BY ALL")
def general_triples(spark, d):
    """Subject, verb and objects of annotated questions without a vocabulary, objects counted."""
    g = parsed.tree_triples(annotated(spark, d), ["qa_id"], {}, {}, {}, general=True)
    return g.groupBy("qa_id", "subject", "predicate").agg(F.count("*").alias("n_objects"))
