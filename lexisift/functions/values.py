"""Value functions: ids, methods, safe numbers. Column in, Column out; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the four prompting methods.
METHOD_ALIASES = {
    "nlq": "nlq", "natural_language": "nlq", "nl": "nlq",
    "sparql": "sparql", "sparql_nlq": "sparql",
    "nlq_cot": "nlq_cot", "nlq_chain": "nlq_cot", "nlq_chain_of_thought": "nlq_cot",
    "sparql_cot": "sparql_cot", "sparql_nlq_cot": "sparql_cot", "sparql_chain": "sparql_cot", "sparql_chain_of_thought": "sparql_cot",
}
METHODS = ("nlq", "nlq_cot", "sparql", "sparql_cot")
CHALLENGERS = ("sparql", "nlq_cot", "sparql_cot")


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def query_key(c: Column) -> Column:
    """Zero-padded six-digit id of anything that reads as a number (truncated toward zero, sign first); otherwise the trimmed text."""
    t = F.trim(c.cast("string"))
    n = finite(t.try_cast("double"))
    i = F.when(F.abs(n) < 9e18, n).cast("bigint")
    digits = F.abs(i).cast("string")
    wide = F.when(i < 0, F.lit(5)).otherwise(F.lit(6))
    padded = F.when(F.length(digits) < wide, F.concat(F.repeat(F.lit("0"), (wide - F.length(digits)).cast("int")), digits)).otherwise(digits)
    return F.coalesce(F.concat(F.when(i < 0, "-").otherwise(""), padded), t)


def query_number(c: Column) -> Column:
    """The integer an id stands for, or null."""
    n = finite(F.trim(c.cast("string")).try_cast("double"))
    return F.when(F.abs(n) < 9e18, n).cast("bigint")


def method_name(c: Column) -> Column:
    """Canonical method; separators and case do not matter, unknown spellings stay as normalised."""
    t = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    table = F.create_map(*[F.lit(x) for kv in METHOD_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, t), t)


def log10_safe(c: Column) -> Column:
    """Base-10 logarithm; null for values that are not positive."""
    return F.when(c > 0, F.log10(c))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def guarded(c: Column, default: float = 0.5, bound: float = 1e8) -> Column:
    """Null, NaN and infinite values become the default; the rest is clipped to the bound."""
    x = finite(c)
    return F.when(x.isNull(), default).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def is_missing_text(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("", "nan", "none", "n/a"), F.lit(True))


def is_error(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("ERROR")) | F.startswith(c, F.lit("DEGENERATE_OUTPUT:")), F.lit(False))


def significance(p: Column, style: str = "stars") -> Column:
    """'stars': ***, **, * or ns; 'marks': + below .001, * below .05, else empty."""
    if style == "marks":
        return F.when(p < 0.001, "+").when(p < 0.05, "*").otherwise("")
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def effect_size(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 0.8, "large").when(a >= 0.5, "medium").otherwise("small")


def epsilon_size(e: Column) -> Column:
    return F.when(e >= 0.14, "large").when(e >= 0.06, "medium").when(e >= 0.01, "small").otherwise("negligible")


def domain_of_path(path: Column) -> Column:
    """finance, legal, telco or unknown, by the first word list that a path matches."""
    p = F.lower(path)
    return F.when(p.rlike("fiqa|finance|financial|fin_"), "finance").when(p.rlike("legal|law"), "legal").when(p.rlike("telco|telecom"), "telco").otherwise("unknown")


def mask_padding(a: Column) -> Column:
    """Log-probabilities without padding: non-finite and exactly zero values dropped, the rest clipped to [-8, 0]."""
    real = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (x != 0) & (F.abs(x) < F.lit(float("inf"))))
    return F.transform(real, lambda x: F.greatest(F.lit(-8.0), F.least(F.lit(0.0), x.cast("double"))))


def confidence(a: Column, default: float = 0.7) -> Column:
    """Mean of the last three scores of an array, or the default."""
    tail = F.slice(a, F.greatest(F.lit(1), F.size(a) - 2), 3)
    total = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.coalesce(F.when(F.size(tail) > 0, total / F.size(tail)), F.lit(default))


def domain_of_name(name: Column, domains=("TelcoQA", "FiQA", "LegalQA")) -> Column:
    """(domain, model) of a table's name: the first known domain in it, without regard to case, and the rest of the name in title case without
    surrounding marks; the whole name is the domain if it holds none."""
    rest, domain = F.lit(None).cast("string"), F.trim(name)
    for d in reversed(domains):
        hit = F.contains(F.lower(name), F.lit(d.lower()))
        left = F.regexp_replace(F.replace(F.lower(name), F.lit(d.lower()), F.lit("")), r"^[_\- ]+|[_\- ]+$", "")
        domain, rest = F.when(hit, d).otherwise(domain), F.when(hit, title(left)).otherwise(rest)
    return F.struct(domain.alias("domain"), rest.alias("model"))


def title(c: Column) -> Column:
    """Every letter after a sign that is none as a capital, the others small."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def cut(columns: dict[str, int]) -> list[Column]:
    """Projections of texts to their first characters, for reports."""
    return [F.substring(c, 1, n).alias(c) for c, n in columns.items()]


def of_extractor(column: str, name: str = "rule_based") -> Column:
    """Rows of one extractor, without regard to case and surrounding blanks."""
    return F.lower(F.trim(F.col(column))) == name.lower()


def id_order(column: str) -> list[Column]:
    """Sort keys for ids: numbers by their value first, then texts."""
    n = F.expr(f"try_cast(`{column}` as double)")
    return [n.isNull().asc(), n.asc(), F.col(column).asc()]
