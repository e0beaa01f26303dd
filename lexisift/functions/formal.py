"""Features of formal query text. Order of operations matters: comments are cut from '#' to the line's end first, also inside IRIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operators with the patterns that count them, and the weights of the complexity score.
OPERATORS = {
    "FILTER": r"\bFILTER\b", "FILTER_NOT_EXISTS": r"\bFILTER\s+NOT\s+EXISTS\b", "OPTIONAL": r"\bOPTIONAL\b", "UNION": r"\bUNION\b",
    "GROUP_BY": r"\bGROUP\s+BY\b", "ORDER_BY": r"\bORDER\s+BY\b", "LIMIT": r"\bLIMIT\b", "DISTINCT": r"\bDISTINCT\b", "HAVING": r"\bHAVING\b",
    "BIND": r"\bBIND\b", "VALUES": r"\bVALUES\b", "SUBQUERY": r"\{[^{}]*SELECT[^{}]*\}", "REGEX": r"\bREGEX\b", "STRSTARTS": r"\bSTRSTARTS\b",
    "COUNT": r"\bCOUNT\s*\(", "AGG_OTHER": r"\b(?:SUM|AVG|MIN|MAX)\s*\(",
}
WEIGHTS = {
    "SUBQUERY": 4.0, "UNION": 3.0, "FILTER_NOT_EXISTS": 3.0, "GROUP_BY": 2.0, "HAVING": 2.0, "FILTER": 2.0, "BIND": 2.0, "OPTIONAL": 1.5,
    "COUNT": 1.5, "AGG_OTHER": 1.5, "DISTINCT": 1.0, "ORDER_BY": 1.0, "REGEX": 1.0, "VALUES": 1.0, "STRSTARTS": 0.5, "LIMIT": 0.5,
}
BOILERPLATE = (
    "select distinct where filter optional union ask describe construct order by group having limit offset bind values not exists rdf type rdfs label owl xsd string true "
    "false and or graph service minus prefix from named as"
).split()
COMMON_VARIABLES = ("?result", "?answer", "?label", "?p", "?o", "?s")
FORMS = ("CONSTRUCT", "DESCRIBE", "ASK", "SELECT")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "#[^\\n]*", "")


def brace_depth(body: Column) -> Column:
    """Deepest running depth of braces, never below 0."""
    marks = F.split(F.regexp_replace(body, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a, c):
        d = a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))

    return F.aggregate(marks, start, step)["m"]


def query_features(df: DataFrame, text: str) -> DataFrame:
    """df with the features of a text column. The cut and upper-cased body is one expression that the optimizer evaluates once.

    A null text gives null features; an empty one zeros and the form UNKNOWN."""
    df = df.withColumn("_body", stripped(F.col(text)))
    df = df.withColumn("_up", F.upper("_body"))
    body, up = F.col("_body"), F.col("_up")
    ops = {k: count(up, p) for k, p in OPERATORS.items()}
    ops["FILTER"] = ops["FILTER"] - count(up, r"\bFILTER\s+NOT\b")
    df = df.withColumns({f"op_{k}": v for k, v in ops.items()})
    op = {k: F.col(f"op_{k}") for k in OPERATORS}
    form = F.coalesce(*[F.when(up.rlike(rf"\b{f}\b"), f) for f in FORMS], F.when(up.isNotNull(), "UNKNOWN"))
    variables = F.regexp_extract_all(body, F.lit(r"\?\w+"), F.lit(0))
    lean = F.regexp_replace(F.regexp_replace(body, r"PREFIX\s+\w+:\s*<[^>]+>", ""), r"<[^>]+>", "")
    tokens = F.filter(F.regexp_extract_all(F.lower(lean), F.lit(r"[a-z_]\w*"), F.lit(0)), lambda t: ~t.isin(*BOILERPLATE) & (F.length(t) > 2))
    df = df.withColumns({"_vars": variables, "_tokens": tokens})
    joins = F.size(F.filter(F.array_distinct("_vars"), lambda v: F.size(F.filter(F.col("_vars"), lambda x: x == v)) >= 2))
    total = sum((op[k] for k in OPERATORS), F.lit(0))
    nary = count(body, r"_:[a-zA-Z0-9]+\s+\w+:(?:hasParticipant|involvesRole)") + count(
        F.col(text), r"#\s*n-ary\s+(?:PRECONDITION_CHAIN|PARTICIPANT_SET|QUANTIFIED_RELATION|TEMPORAL_CONTEXT|SPATIAL_CONTEXT|CONDITIONAL_ROLE)"
    ) + F.when(count(up, r"FILTER\s+EXISTS\s*\{") >= 2, 1).otherwise(0)
    df = df.withColumns(
        {
            "query_form": form,
            "complexity_score": sum((op[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)),
            "nary_count": nary,
            "has_negation": F.upper(text).rlike(r"\bFILTER\s+NOT\s+EXISTS\b|\bMINUS\b").cast("int"),
            "has_annotation": F.col(text).rlike(r"_:queryMeta\s+rdf:type|rdfs:comment[^\n]*@en").cast("int"),
            "operator_count": total.cast("int"),
            "operator_diversity": sum(((op[k] > 0).cast("int") for k in OPERATORS), F.lit(0)),
            "join_count": joins,
            "nesting_depth": brace_depth(body),
            "entity_count": F.size(F.array_except(F.array_distinct("_vars"), F.array(*[F.lit(v) for v in COMMON_VARIABLES]))),
            "class_count": count(body, r"rdf:type\b"),
            "relation_count": count(body, r"(?:broadband|landline|legal|case|fi|property):\w+\s+\?"),
            "literal_count": count(body, r'"[^"]*"'),
            "namespace_count": F.size(F.array_distinct(F.regexp_extract_all(up, F.lit(r"\bPREFIX\s+(\w+):"), F.lit(1)))),
            "vocab_tokens": F.size("_tokens"),
            "type_count": F.size(F.array_distinct("_tokens")),
            "line_count": F.size(F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), "\n")),
            "token_count": count(body, r"\S+"),
            "char_count": F.length(text),
        }
    )
    df = df.withColumn("ttr", F.round(F.coalesce(F.try_divide(F.col("type_count"), F.col("vocab_tokens")), F.lit(0.0)), 4))
    df = df.withColumn("compositional_score", F.round(2.0 * F.col("operator_diversity") + 1.5 * F.col("join_count") + F.col("nesting_depth"), 2))
    return df.drop("_body", "_up", "_vars", "_tokens")


FEATURES = (
    "query_form complexity_score nary_count has_negation has_annotation operator_count operator_diversity join_count nesting_depth compositional_score entity_count class_count "
    "relation_count literal_count namespace_count ttr vocab_tokens line_count token_count char_count"
).split()


def described(form: Column, joins: Column) -> Column:
    """Stand-in for a missing question."""
    return F.concat(F.lit("[Auto-inferred] "), form, F.lit(" query with "), joins.cast("string"), F.lit(" join(s)"))


def jaccard_tokens(a: Column, b: Column) -> Column:
    """Jaccard similarity of the identifier sets of two texts: 1 if both are empty, 0 if one is."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z_]\w*"), F.lit(0))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)
