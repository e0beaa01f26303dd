"""Graph-pattern algebra over a table of triples (s, p, o): the operators of formal queries as joins that the optimizer orders."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Solutions of one triple pattern: terms that start with ? are variables, others constants. A repeated variable must agree."""
    out, names = triples, {}
    for col, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            out = out.filter(F.col(col) == term)
        elif term[1:] in names:
            out = out.filter(F.col(col) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = col
    return out.select(*[F.col(c).alias(v) for v, c in names.items()]) if names else out.select(F.lit(True).alias("_found"))


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def bgp(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Basic graph pattern: equi-joins on shared variables. Patterns must be connected; unconnected ones are refused."""
    parts = [pattern(triples, *p) for p in patterns]
    done, rest = parts[0], parts[1:]
    while rest:
        at = next((i for i, x in enumerate(rest) if _shared(done, x)), None)
        if at is None:
            raise ValueError("the patterns share no variable")
        x = rest.pop(at)
        done = done.join(x, _shared(done, x))
    return done


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left")


def union(*parts: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left_anti")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left_semi")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions of left that no solution of right agrees with; without a shared variable nothing is taken away."""
    shared = _shared(left, right)
    return left.join(right.select(*shared).distinct(), shared, "left_anti") if shared else left


def subquery(solutions: DataFrame, inner: DataFrame) -> DataFrame:
    """Solutions joined with those of a query of their own, on the variables that both have; there must be one."""
    shared = _shared(solutions, inner)
    if not shared:
        raise ValueError("the subquery shares no variable")
    return solutions.join(inner, shared)


def string(term) -> Column:
    """STR(): the lexical form of a literal, or the address of a resource without its angle brackets."""
    quoted = F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z-]+|\^\^\S+)?$', 1)
    return F.when(term.rlike(r'(?s)^".*"(?:@[A-Za-z-]+|\^\^\S+)?$'), F.replace(quoted, F.lit('\\"'), F.lit('"'))).otherwise(F.regexp_replace(term, "^<|>$", ""))


def literal(value, lang: str | None = None, datatype: str | None = None) -> Column:
    """A literal as a term, quotes escaped, with its language or datatype."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"' + (f"@{lang}" if lang else f"^^{datatype}" if datatype else "")))


def lang(term) -> Column:
    """LANG(): the language of a literal, empty without one."""
    return F.regexp_extract(term, r'(?s)^".*"@([A-Za-z-]+)$', 1)


def datatype(term) -> Column:
    """DATATYPE(): the datatype of a literal, xsd:string without one; null for resources."""
    kind = F.regexp_extract(term, r'(?s)^".*"\^\^(\S+)$', 1)
    return F.when(term.rlike('(?s)^".*"'), F.when(kind != "", kind).otherwise("xsd:string"))


def blank(*parts) -> Column:
    """A blank node of its own for every value of the parts."""
    return F.concat(F.lit("_:b"), F.hex(F.xxhash64(*parts)))


def expanded(term, prefixes: dict[str, str]) -> Column:
    """A prefixed name as its full address in angle brackets; other terms stay."""
    out = term
    for k, base in prefixes.items():
        out = F.when(F.startswith(term, F.lit(k + ":")), F.concat(F.lit("<" + base), F.substring(term, len(k) + 2, 1 << 20), F.lit(">"))).otherwise(out)
    return out


def starts(solutions: DataFrame, variable: str, text: str) -> DataFrame:
    """FILTER(STRSTARTS(STR(?variable), text))"""
    return solutions.filter(F.startswith(string(F.col(variable)), F.lit(text)))


def matches(solutions: DataFrame, variable: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """FILTER(REGEX(STR(?variable), pattern))"""
    return solutions.filter(string(F.col(variable)).rlike(("(?i)" if ignore_case else "") + pattern))


def ask(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution. Reads no more than one."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def describe(triples: DataFrame, subject: str) -> DataFrame:
    return triples.filter(F.col("s") == subject)


def construct(solutions: DataFrame, *template: tuple[str, str, str]) -> DataFrame:
    """Distinct triples of the template for every solution; triples with an unbound variable are left out."""
    term = lambda t: F.col(t[1:]).cast("string") if t.startswith("?") else F.lit(t)
    rows = F.explode(F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template]))
    return solutions.select(rows.alias("t")).select("t.*").filter("s is not null and p is not null and o is not null").distinct()


def values(spark, name: str, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], f"`{name}` string")


def bind(solutions: DataFrame, name: str, expr) -> DataFrame:
    return solutions.withColumn(name, expr)


def select(solutions: DataFrame, variables: list[str], distinct: bool = False, order=(), limit: int | None = None) -> DataFrame:
    """Projection with DISTINCT, ORDER BY and LIMIT; an order is needed for a limit."""
    out = solutions.select(*variables)
    out = out.distinct() if distinct else out
    if limit is not None and not order:
        raise ValueError("a limit needs an order")
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def grouped(solutions: DataFrame, keys: list[str], aggs: dict, having=None) -> DataFrame:
    out = solutions.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    return out.filter(having) if having is not None else out
