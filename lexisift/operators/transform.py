"""Question to formal query by rules given as data: types, intents, context, properties, logical form, description, query text.

Rules are ordered (label, pattern) pairs and vocabularies are surface-to-name maps, both passed in; the engine holds none of a
domain's own. All steps are column expressions over one row, so a question never leaves its partition;
they take the text as folded() gives it, in a column of its own. What needs a parser comes in
as an optional column (see operators/parsed); without it, relations come from surface forms."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATED = r"\b(?:not|doesn't|don't|cannot|can't|never|without)\b"
_NONE = "array<string>"
TRIPLE = "array<struct<s:string,p:string,o:string>>"
SPO = "array<struct<s:string,p:string,o:string,negated:boolean>>"
ENTITY = "array<struct<surface:string,name:string,first:int,negated:boolean>>"


def folded(text: Column) -> Column:
    """Trimmed lower case in which letters beyond ASCII are an x, so that word boundaries of patterns mean the same everywhere."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"[^\x00-\x7F\p{P}\p{S}\p{Z}]", "x")


def first_label(text: Column, rules, default: str | None) -> Column:
    """Label of the first rule whose pattern is found in the folded text; null for a null text."""
    out = None
    for label, p in rules:
        out = F.when(text.rlike(p), label) if out is None else out.when(text.rlike(p), label)
    return F.when(text.isNotNull(), F.lit(default) if out is None else out.otherwise(default))


def labels_found(text: Column, rules) -> Column:
    """Labels of all rules whose patterns are found in the folded text, each once, in the order of the rules."""
    return F.array_distinct(F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules]), lambda x: x.isNotNull()))


def metadata(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with an array of the values that each pattern finds in the text as written; empty for null."""
    return df.withColumns({k: F.coalesce(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), F.array().cast(_NONE)) for k, p in patterns.items()})


def by_map(key: Column, table: dict[str, str], other: Column | str | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    other = F.lit(other) if not isinstance(other, Column) else other
    return other if out is None else out.otherwise(other)


# ---- context -------------------------------------------------------------------------------------------------------------------


def institute(t: Column, document: Column, rules, default: str) -> Column:
    """By the folded question and the folded name of a document beside it, which may be null."""
    return first_label(F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce(document, F.lit(""))), rules, default)


def document(t: Column, inst: Column, documents: dict, numbers: Column, known: dict[str, str]) -> Column:
    """The document by the institute's rules; a known document number in the text goes first for the last institute. Empty if none."""
    first = F.try_element_at(F.filter(numbers, lambda n: n.isin(*known)), F.lit(1))
    out, names = F.lit(""), list(documents)
    for name in reversed(names):
        by_rule = F.coalesce(first_label(t, documents[name], ""), F.lit(""))
        if name == names[-1]:
            by_rule = F.coalesce(by_map(first, known), by_rule)
        out = F.when(inst == name, by_rule).otherwise(out)
    return out


def jurisdiction(question: Column, t: Column, places, courts: dict[str, str], words, default: str) -> Column:
    """By a place named, else by the court of the first citation, else by words."""
    court = F.lower(F.regexp_extract(question, r"\[\d{4}\]\s*([A-Za-z]+)\s*\d+", 1))
    of_court = by_map(court, {c: j for j, cs in courts.items() for c in cs.split()})
    place = first_label(t, [(k, re.escape(p)) for p, k in places], None)
    return F.when(question.isNotNull(), F.coalesce(place, of_court, first_label(t, words, default)))


def mentions(text: Column, words) -> Column:
    """Whether any of the words is contained in the text; false for null."""
    return F.coalesce(functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


# ---- classification ------------------------------------------------------------------------------------------------------------


def legal_query_type(question: Column, t: Column, rules, default: str, cited: str) -> Column:
    """By rules; a cited case 'in the case of' keeps the default where only the last rule, on acts, would hold."""
    case = question.rlike(cited) & t.rlike(r"in\s+the\s+case\s+of")
    label = first_label(t, rules, default)
    return F.when((label == rules[-1][0]) & case, default).otherwise(label)


def focus_variable(form: Column, intent: Column, by_form: dict, by_intent: dict, default: Column) -> Column:
    """Empty for polar questions and questions of existence; else by type, then by intent, then the default."""
    return F.when(form.isin("POLAR", "EXISTENCE"), "").otherwise(F.coalesce(by_map(form, by_form), by_map(intent, by_intent), default))


def projected_fields(query_type: Column, text: Column, fields: dict[str, list[str]], words: dict[str, tuple], most: int = 3) -> Column:
    """The primary field of the query type, then the others by (score, name) descending; a word found in the text scores 2. At most so many."""
    t = text
    scored = sorted({f for v in fields.values() for f in v})
    score = {f: functools.reduce(lambda a, b: a + b, [F.when(t.rlike(w), 2).otherwise(0) for w in words.get(f, ())], F.lit(0)) for f in scored}
    out = F.array(F.lit("result"))
    for kind, names in fields.items():
        rest = F.array(*[F.struct(score[f].alias("score"), F.lit(f).alias("name")) for f in names[1:] if f != names[0]])
        best = F.transform(F.slice(F.reverse(F.array_sort(rest)), 1, most - 1), lambda x: x["name"])
        out = F.when(query_type == kind, F.concat(F.array(F.lit(names[0])), best)).otherwise(out)
    return F.when(text.isNotNull(), out)


def category_fields(text: Column, category: Column, rules, defaults: dict[str, tuple], other: tuple) -> Column:
    """Fields whose words are found, in order; if none is, those of the category."""
    found = labels_found(text, rules)
    out = F.array(*[F.lit(x) for x in other])
    for k, names in defaults.items():
        out = F.when(category == k, F.array(*[F.lit(x) for x in names])).otherwise(out)
    return F.when(F.size(found) > 0, found).otherwise(out)


# ---- extraction ----------------------------------------------------------------------------------------------------------------


def _longest(vocabulary: dict[str, str]) -> list[str]:
    return sorted(vocabulary, key=lambda k: -len(k))


def entities_by_surface(text: Column, vocabulary: dict[str, str]) -> Column:
    """Entities of a text by word-bounded surfaces, in order of their first place; a surface that stands only inside a longer found one is
    dropped. negated: a negation in the twenty characters before. For every occurrence see operators/triples.entity_spans."""
    t, rows = text, []
    for k in _longest(vocabulary):
        at = F.length(F.regexp_extract(t, rf"(?s)^(.*?)(?:^|[^\w]){re.escape(k)}(?:[^\w]|$)", 1))
        hit = t.rlike(rf"(?:^|[^\w]){re.escape(k)}(?:[^\w]|$)")
        before = F.substring(t, F.greatest(at + 1 - 20, F.lit(1)), F.least(F.lit(20), at + 1))
        rows.append(F.when(hit, F.struct(F.lit(k).alias("surface"), F.lit(vocabulary[k]).alias("name"), at.alias("first"), before.rlike(r"\b(?:no|not|without|never|cannot|can't)\b").alias("negated"))))
    if not rows:
        return F.array().cast(ENTITY)
    hits = F.filter(F.array(*rows), lambda x: x.isNotNull())
    inside = lambda x: F.exists(hits, lambda y: (F.length(y["surface"]) > F.length(x["surface"])) & F.contains(y["surface"], x["surface"]) & (F.abs(y["first"] - x["first"]) <= F.length(y["surface"])))
    return F.array_sort(F.filter(hits, lambda x: ~inside(x)), lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)).cast(ENTITY)


def data_properties(text: Column, vocabulary: dict[str, str], found: dict[str, Column] | None = None) -> Column:
    """array of (surface, name, value): contained surfaces, longest first, one per name, with the value that follows white space, a colon
    or an equals sign; then the first metadata value of each name in found that no surface gave."""
    t = text
    kind = "array<struct<surface:string,name:string,value:string>>"
    value = lambda k: F.nullif(F.regexp_extract(t, re.escape(k) + r"[\s:=]+([\w.\-#%]+)", 1), F.lit(""))
    rows = [F.when(F.contains(t, F.lit(k)), F.struct(F.lit(k).alias("surface"), F.lit(vocabulary[k]).alias("name"), value(k).alias("value"))) for k in _longest(vocabulary)]
    for name, values in (found or {}).items():
        v = F.try_element_at(values, F.lit(1))
        rows.append(F.when(v.isNotNull(), F.struct(v.alias("surface"), F.lit(name).alias("name"), v.alias("value"))))
    if not rows:
        return F.array().cast(kind)
    hits = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return F.filter(hits, lambda x, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda y: y["name"] == x["name"])).cast(kind)


def surface_relations(text: Column, vocabulary: dict[str, str]) -> Column:
    """array of (surface, name, negated): contained surfaces, longest first; negated by a negation in the 25 characters before the first."""
    t = text
    kind = "array<struct<surface:string,name:string,negated:boolean>>"
    rows = []
    for k in _longest(vocabulary):
        at = F.instr(t, k)
        before = F.substring(t, F.greatest(at - 25, F.lit(1)), F.least(at - 1, F.lit(25)))
        rows.append(F.when(at > 0, F.struct(F.lit(k).alias("surface"), F.lit(vocabulary[k]).alias("name"), before.rlike(NEGATED).alias("negated"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull()).cast(kind) if rows else F.array().cast(kind)


def status_indicators(text: Column, lights, colours) -> Column:
    """array of 'light:state_colour', 'light_status:state' where no colour goes with any state so far, and 'color:colour' for colours that are
    in no state."""
    t = text
    has = lambda w: F.contains(t, F.lit(w))
    some_colour = functools.reduce(lambda a, b: a | b, [has(c) for c in colours])
    rows = [F.when(has(s) & has(c), F.lit(f"light:{s}_{c}")) for s in lights for c in colours]
    rows += [F.when(has(s) & ~some_colour, F.lit(f"light_status:{s}")) for s in lights]
    some_light = functools.reduce(lambda a, b: a | b, [has(s) for s in lights])
    rows += [F.when(has(c) & ~some_light, F.lit(f"color:{c}")) for c in colours]
    return F.when(text.isNotNull(), F.filter(F.array(*rows), lambda x: x.isNotNull()))


# ---- logical form and description ----------------------------------------------------------------------------------------------


def variable(name: Column) -> Column:
    """?name with a small first letter; a prefix goes."""
    local = F.element_at(F.split(name, ":"), -1)
    return F.concat(F.lit("?"), F.lower(F.substring(local, 1, 1)), F.substring(local, 2, 1 << 20))


def term_variable(text: Column) -> Column:
    """?variable from any text: other signs than letters and digits become _, a leading digit gets an x."""
    c = F.regexp_replace(F.trim(text), "[^a-zA-Z0-9]", "_")
    c = F.when(c.rlike("^[A-Za-z_]"), c).otherwise(F.concat(F.lit("x"), c))
    return F.concat(F.lit("?"), F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def classified_triples(spo: Column, form: Column, focus: Column, restriction: bool) -> Column:
    """The triples that restrict the answer (the focus is their subject or object) or, otherwise, those presupposed; polar questions and
    questions of existence presuppose all."""
    hit = lambda x: ~form.isin("POLAR", "EXISTENCE") & (focus != "") & ((x["s"] == focus) | (x["o"] == focus))
    return F.filter(spo, lambda x: hit(x) if restriction else ~hit(x))


def logical_form(df: DataFrame, t: str, q_form: Column, intent: Column, vocabulary: dict[str, str], relations: dict[str, str], properties: dict[str, str], by_form: dict, by_intent: dict, default: str, found: dict[str, Column] | None = None, spo: str | None = None) -> DataFrame:
    """df with, from its folded text t, q_type, intent, entities, nary (those after the second), relations, properties, focus, spo, presuppositions, restrictions,
    negations, conjunctions, groups (entities by the parts around ' or '), quantifier, connective and negated."""
    t = F.col(t)
    df = df.withColumns({"q_type": q_form, "intent": intent, "entities": entities_by_surface(t, vocabulary), "relations": surface_relations(t, relations), "properties": data_properties(t, properties, found)})
    df = df.withColumn("spo", F.coalesce(F.col(spo), F.array().cast(SPO)) if spo else F.array().cast(SPO))
    first = F.try_element_at("entities", F.lit(1))["name"]
    df = df.withColumn("focus", focus_variable(F.col("q_type"), F.col("intent"), by_form, by_intent, F.coalesce(variable(first), F.lit(default)) if default == "?answer" else F.lit(default)))
    groups = F.filter(F.transform(F.split(t, " or "), lambda part: F.filter("entities", lambda e: F.contains(part, e["surface"]))), lambda g: F.size(g) > 0)
    of_triples = F.filter(F.transform(groups, lambda g: F.filter("spo", lambda x: F.exists(g, lambda e: (x["s"] == variable(e["name"])) | (x["o"] == variable(e["name"]))))), lambda g: F.size(g) > 0)
    df = df.withColumns(
        {
            "nary": F.slice("entities", 3, 1 << 20),
            "presuppositions": classified_triples(F.col("spo"), F.col("q_type"), F.col("focus"), False),
            "restrictions": classified_triples(F.col("spo"), F.col("q_type"), F.col("focus"), True),
            "negations": F.filter("spo", lambda x: x["negated"]),
            "conjunctions": F.when(t.rlike(r"\bboth\b|\band\b|\bas well as\b"), F.filter("spo", lambda x: ~x["negated"])).otherwise(F.array().cast(SPO)),
            "groups": F.when(F.contains(t, F.lit(" or ")), groups).otherwise(F.array().cast(f"array<{ENTITY}>")),
            "disjunctions": F.when(F.contains(t, F.lit(" or ")) & (F.size(of_triples) > 1), of_triples).otherwise(F.array().cast(f"array<{SPO}>")),
            "quantifier": F.when(t.rlike(r"\ball\b|\bevery\b|\beach\b"), "universal").otherwise("existential"),
        }
    )
    return df.withColumns({"connective": F.when(F.size("disjunctions") > 0, "OR").otherwise("AND"), "negated": F.size("negations") > 0})


def _triples(*rows: Column) -> Column:
    return F.filter(F.array(*rows), lambda x: x.isNotNull()).cast(TRIPLE)


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


PRECONDITION, QUANTITIES = ("requires", "dependsOn"), ("hasSpeed", "hasPrice", "hasQuantity")


def description(df: DataFrame, prefix: str, fallback: str, statuses: str | None = None, ner: str | None = None) -> DataFrame:
    """df with the description-logic form of a logical form: concepts, roles, not_roles, data, unions, classes and nary_kind.

    Roles come from triples, else from surface relations between the first two entities, else the fallback links them. ner: optional
    column of (label, surface, data_prop) from an annotator. A kind of n-ary relation holds where a question names more than two
    entities and a relation."""
    curie = lambda n: F.concat(F.lit(prefix + ":"), n)
    nth = lambda i: F.try_element_at("entities", F.lit(i))["name"]
    sv, ov = F.coalesce(variable(nth(1)), F.lit("?subject")), F.coalesce(variable(nth(2)), F.lit("?object"))
    concepts = F.transform("entities", lambda e: F.struct(variable(e["name"]).alias("v"), curie(e["name"]).alias("c")))
    flat = lambda want: F.array_distinct(F.transform(F.filter("spo", lambda x: x["negated"] == want), lambda x: _triple(x["s"], curie(x["p"]), x["o"]))).cast(TRIPLE)
    by_surface = lambda want: F.transform(F.filter("relations", lambda r: r["negated"] == want), lambda r: _triple(sv, curie(r["name"]), ov)).cast(TRIPLE)
    df = df.withColumns({"concepts": concepts, "_r1": flat(False), "_n1": flat(True)})
    empty = (F.size("_r1") == 0) & (F.size("_n1") == 0)
    linked = _triples(F.when(F.size("entities") >= 2, _triple(sv, F.lit(f"{prefix}:{fallback}"), ov)))
    roles = F.when(~empty, F.col("_r1")).when(F.size("relations") > 0, by_surface(False)).otherwise(linked)
    props = F.transform("properties", lambda d: _triple(sv, curie(d["name"]), F.coalesce(F.concat(F.lit('"'), d["value"], F.lit('"')), F.concat(F.lit("?"), d["name"])))).cast(TRIPLE)
    more = [props]
    if ner:
        fresh = F.filter(F.coalesce(F.col(ner), F.array().cast("array<struct<label:string,surface:string,data_prop:string>>")), lambda h: h["data_prop"].isNotNull() & ~F.exists("properties", lambda d: d["name"] == h["data_prop"]))
        more.append(F.transform(F.filter(fresh, lambda h, i: ~F.exists(F.slice(fresh, F.lit(1), i), lambda y: y["data_prop"] == h["data_prop"])), lambda h: _triple(sv, curie(h["data_prop"]), F.concat(F.lit('"'), h["surface"], F.lit('"')))).cast(TRIPLE))
    if statuses:
        more.append(F.transform(statuses, lambda s: _triple(sv, curie(F.lit("hasStatusIndicator")), F.concat(F.lit('"'), s, F.lit('"')))).cast(TRIPLE))
    data = F.when(F.size("entities") > 0, F.concat(*more)).otherwise(F.array().cast(TRIPLE))
    of_group = F.transform("groups", lambda g: F.transform(g, lambda e: _triple(variable(e["name"]), F.lit("rdf:type"), curie(e["name"])))).cast(f"array<{TRIPLE}>")
    of_spo = F.transform("disjunctions", lambda g: F.transform(g, lambda x: _triple(x["s"], curie(x["p"]), x["o"]))).cast(f"array<{TRIPLE}>")
    classes = F.concat(
        F.transform("groups", lambda g: F.concat(F.lit("owl:unionOf("), F.concat_ws(" ", F.transform(g, lambda e: curie(e["name"]))), F.lit(")"))),
        F.when(F.col("quantifier") == "universal", F.array(F.lit("owl:allValuesFrom"))).otherwise(F.array().cast(_NONE)),
    )
    role = F.try_element_at("relations", F.lit(1))["name"]
    labelled = lambda *labels: F.exists(F.coalesce(F.col(ner), F.array().cast("array<struct<label:string,surface:string,data_prop:string>>")), lambda h: h["label"].isin(*labels)) if ner else F.lit(False)
    kind = (
        F.when(role.isin(*PRECONDITION), "PRECONDITION_CHAIN").when(F.exists("properties", lambda d: d["name"].isin(*QUANTITIES)), "QUANTIFIED_RELATION")
        .when(labelled("DATE"), "TEMPORAL_CONTEXT").when(labelled("GPE", "LOC", "FAC"), "SPATIAL_CONTEXT").otherwise("CONDITIONAL_ROLE")
    )
    out = df.withColumns(
        {
            "roles": roles,
            "not_roles": F.when(~empty, F.col("_n1")).otherwise(by_surface(True)),
            "data": data,
            "unions": F.concat(of_group, of_spo),
            "classes": classes,
            "nary_kind": F.when((F.size("nary") > 0) & (F.size("relations") > 0), kind),
        }
    )
    return out.drop("_r1", "_n1")


def ner_map(ner: Column, labels: dict[str, tuple]) -> Column:
    """Annotated entities (label, surface) with the class or data property of their label; unknown labels go."""
    cls, prop = {k: c for k, (c, _) in labels.items() if c}, {k: p for k, (_, p) in labels.items() if p}
    known = F.filter(ner, lambda h: h["label"].isin(*labels))
    return F.transform(known, lambda h: F.struct(h["label"].alias("label"), h["surface"].alias("surface"), by_map(h["label"], cls).alias("class"), by_map(h["label"], prop).alias("data_prop")))
