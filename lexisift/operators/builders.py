"""Query text from a described question: templates as data, rendered by column expressions.

A template has the variables it selects, its pattern lines and its order. Marks in braces stand for parts of the question: {main}
and {class} the first concept, {e1}, {e2} the first two entities as variables with {c1}, {c2} as classes, {focus|?x} the focus variable
or another, {ns} the prefix. A line may be a block of the description: @types, @roles, @data, @data?, @union, @nary, @status."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transform import escaped, variable

VOCABULARIES = (("owl", "http://www.w3.org/2002/07/owl#"), ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"), ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("xsd", "http://www.w3.org/2001/XMLSchema#"))


@dataclass(frozen=True)
class Template:
    head: str
    lines: tuple[str, ...]
    order: str = ""
    when: str = "true"  # SQL condition on the described row; the first template whose condition holds is taken
    construct: tuple[str, ...] = field(default=())


def _opt(*lines: str) -> tuple[str, ...]:
    return tuple(f"OPTIONAL {{ {x} . }}" for x in lines)


# The query shapes by intent.
TEMPLATES: dict[str, tuple[Template, ...]] = {
    "ASK_BOOLEAN": (Template("ASK", ("@types", "@roles", "@data", "@union")),),
    "ASK_EXISTS": (Template("ASK", ("@types", "@inactive", "@target")),),
    "DESCRIBE_ENTITY": (Template("DESCRIBE {classes}", ("@positive",), when="size(entities) > 0"), Template("DESCRIBE ?resource", ("?resource rdf:type {ns}:Device .",))),
    "CONSTRUCT_GRAPH": (Template("CONSTRUCT", ("@types", "@positive", "@data?", "@anything", "@union"), construct=("@types", "@positive", "@data", "@main")),),
    "SELECT_TROUBLESHOOT": (
        Template("SELECT DISTINCT {main} ?issue ?issueType {focus|?cause} ?solution ?priority ?nextStep", ("{main} rdf:type {class} .", "@status", "{main} {ns}:hasIssue ?issue .", "?issue {ns}:issueType ?issueType .", "?issue {ns}:hasCause {focus|?cause} .", "?issue {ns}:hasSolution ?solution .", *_opt("?issue {ns}:hasPriority ?priority", "?solution {ns}:hasNextStep ?nextStep"), "@negated", "@union", "@nary"), "?priority ?issue"),
    ),
    "SELECT_ISSUES": (Template("SELECT DISTINCT {main} ?issue ?issueType ?frequency ?cause ?solution", ("{main} rdf:type {class} .", "{main} {ns}:hasKnownIssue ?issue .", "?issue {ns}:issueType ?issueType .", "?issue {ns}:hasFrequency ?frequency .", "?issue {ns}:hasCause ?cause .", "?issue {ns}:hasSolution ?solution .", "@union"), "DESC(?frequency) ?issueType"),),
    "SELECT_COMPATIBILITY": (
        Template("SELECT DISTINCT {e1} {e2} ?compatibilityStatus ?restriction", ("{e1} rdf:type {c1} .", "{e2} rdf:type {c2} .", "{e1} {ns}:isCompatibleWith {e2} .", *_opt("{e1} {ns}:compatibilityStatus ?compatibilityStatus", "{e1} {ns}:hasRestriction ?restriction"), "FILTER NOT EXISTS { {e1} {ns}:isIncompatibleWith {e2} . }", "@union"), "?compatibleWith", "size(entities) >= 2"),
        Template("SELECT DISTINCT {e1} {focus|?compatibleWith} ?category ?restriction", ("{e1} rdf:type {c1} .", "{e1} {ns}:isCompatibleWith {focus|?compatibleWith} .", *_opt("{focus|?compatibleWith} rdf:type ?category", "{focus|?compatibleWith} {ns}:hasRestriction ?restriction"), "@union"), "?compatibleWith", "size(entities) = 1"),
        Template("SELECT DISTINCT ?subject {focus|?compatibleWith} ?restriction", ("?subject {ns}:isCompatibleWith {focus|?compatibleWith} .", *_opt("{focus|?compatibleWith} {ns}:hasRestriction ?restriction"), "@union"), "?compatibleWith"),
    ),
    "SELECT_REQUIREMENTS": (
        Template("SELECT DISTINCT {e1} {e2} ?requirement ?isMandatory ?details", ("{e1} rdf:type {c1} .", "{e2} rdf:type {c2} .", "{e1} {ns}:requires ?requirement .", *_opt("?requirement {ns}:isMandatory ?isMandatory", "?requirement {ns}:hasDetails ?details", "{e2} {ns}:requires ?requirement"), "@nary"), "DESC(?isMandatory) ?requirement", "size(entities) >= 2"),
        Template("SELECT DISTINCT {e1} ?requirement ?isMandatory", ("{e1} rdf:type {c1} .", "{e1} {ns}:requires ?requirement .", *_opt("?requirement {ns}:isMandatory ?isMandatory"), 'FILTER(?isMandatory = "true"^^xsd:boolean)', "@nary"), "DESC(?isMandatory) ?requirement", "size(entities) = 1 and quantifier = 'universal'"),
        Template("SELECT DISTINCT {e1} ?requirement ?isMandatory ?priority", ("{e1} rdf:type {c1} .", "{e1} {ns}:requires ?requirement .", *_opt("?requirement {ns}:isMandatory ?isMandatory", "?requirement {ns}:hasPriority ?priority"), "@nary"), "DESC(?isMandatory) ?requirement", "size(entities) = 1"),
        Template("SELECT DISTINCT ?entity ?requirement ?isMandatory", ("?entity {ns}:requires ?requirement .", *_opt("?requirement {ns}:isMandatory ?isMandatory"), "@nary"), "DESC(?isMandatory) ?requirement"),
    ),
    "SELECT_ACCOUNT": (
        Template("SELECT DISTINCT ?account ?contractEndDate ?terminationFee ?cancelProcess", ("?account rdf:type {ns}:Account .", "?account {ns}:hasContract ?contract .", *_opt("?contract {ns}:hasContractEndDate ?contractEndDate", "?contract {ns}:hasTerminationFee ?terminationFee", "?account {ns}:hasCancellationProcess ?cancelProcess"), 'FILTER NOT EXISTS { ?account {ns}:hasStatus "cancelled"^^xsd:string . }'), "?account", "array_contains(actions, 'cancel')"),
        Template("SELECT DISTINCT {main} ?upgradePlan ?upgradePrice ?upgradeAvailability", ("{main} rdf:type {class} .", "{main} {ns}:upgradesTo ?upgradePlan .", *_opt("?upgradePlan {ns}:hasPrice ?upgradePrice", "?upgradePlan {ns}:hasAvailability ?upgradeAvailability")), "?account", "array_contains(actions, 'upgrade')"),
        Template("SELECT DISTINCT ?account {focus|?details}", ("?account rdf:type {ns}:Account .", "?account {ns}:hasContract ?contract .", "?contract {ns}:hasContractEndDate {focus|?details} ."), "?account", "q_type = 'WH_WHEN'"),
        Template("SELECT DISTINCT ?account ?billAmount ?dueDate ?paymentMethod", ("?account rdf:type {ns}:Account .", *_opt("?account {ns}:hasBillAmount ?billAmount", "?account {ns}:hasDueDate ?dueDate", "?account {ns}:hasPaymentMethod ?paymentMethod")), "?account"),
    ),
    "SELECT_CONFIGURE": (
        Template("SELECT DISTINCT {main} {properties} {focus|?steps}", ("{main} rdf:type {class} .", "@settings", *_opt("{main} {ns}:hasConfigurationStep {focus|?steps}")), "?settingName", "size(properties) > 0"),
        Template("SELECT DISTINCT {main} ?settingName ?currentValue {focus|?steps}", ("{main} rdf:type {class} .", "{main} {ns}:hasSetting ?settingName .", *_opt("?settingName {ns}:hasCurrentValue ?currentValue", "?settingName {ns}:hasAllowedValues ?allowedValues", "{main} {ns}:hasConfigurationStep {focus|?steps}")), "?settingName"),
    ),
    "SELECT_PROPERTY": (
        Template("SELECT DISTINCT {main} {properties}", ("@types", "@data", "@roles"), "{main}", "size(data) > 0"),
        Template("SELECT DISTINCT {main} {focus|?propertyValue}", ("@types", "{main} ?anyProp {focus|?propertyValue} .", "FILTER(STRSTARTS(STR(?anyProp), STR({ns}:has)))", "@roles"), "{main}"),
    ),
    "SELECT_GENERAL": (Template("SELECT DISTINCT {variables} {focus|?value} ?property", ("@types", "@roles", "@union", "{main} ?property {focus|?value} .", *_opt("?property rdfs:label ?label"), "@data?", "FILTER(STRSTARTS(STR(?property), STR({ns}:)))"), "?property"),),
}


def _lines(rows: Column, form) -> Column:
    return F.transform(rows, form)


def _dot(x: Column) -> Column:
    return F.concat_ws(" ", x["s"], x["p"], x["o"], F.lit("."))


class _Row:
    """The parts of a described question as columns."""

    def __init__(self, ns: str):
        self.ns = ns
        name = lambda i: F.try_element_at("entities", F.lit(i))["name"]
        self.main = F.coalesce(variable(name(1)), F.lit("?entity"))
        self.cls = F.concat(F.lit(ns + ":"), F.coalesce(name(1), F.lit("Device")))
        self.marks = {
            "{main}": self.main,
            "{class}": self.cls,
            "{ns}": F.lit(ns),
            "{classes}": F.concat_ws(" ", F.transform("concepts", lambda c: c["c"])),
            "{variables}": F.concat_ws(" ", F.array_distinct(F.transform("concepts", lambda c: c["v"]))),
            "{properties}": F.concat_ws(" ", F.array_distinct(F.transform("properties", lambda d: F.concat(F.lit("?"), d["name"])))),
            **{f"{{e{i}}}": F.coalesce(variable(name(i)), F.lit("")) for i in (1, 2)},
            **{f"{{c{i}}}": F.concat(F.lit(ns + ":"), F.coalesce(name(i), F.lit(""))) for i in (1, 2)},
        }

    def text(self, line: str) -> Column:
        out = F.lit(line)
        at = line.find("{focus|")
        if at >= 0:
            mark = line[at : line.index("}", at) + 1]
            out = F.replace(out, F.lit(mark), F.coalesce(F.nullif(F.col("focus"), F.lit("")), F.lit(mark[7:-1])))
        for m, c in self.marks.items():
            if m in line:
                out = F.replace(out, F.lit(m), c)
        return out

    def block(self, name: str) -> Column:
        ns, main = self.ns, self.main
        blocks = {
            "@types": lambda: _lines("concepts", lambda c: F.concat_ws(" ", c["v"], F.lit("rdf:type"), c["c"], F.lit("."))),
            "@positive": lambda: _lines("roles", _dot),
            "@roles": lambda: F.concat(_lines("roles", _dot), _lines("not_roles", lambda x: F.concat(F.lit("FILTER NOT EXISTS { "), _dot(x), F.lit(" }")))),
            "@data": lambda: _lines("data", _dot),
            "@data?": lambda: _lines("data", lambda x: F.concat(F.lit("OPTIONAL { "), _dot(x), F.lit(" }"))),
            "@union": lambda: F.when(F.size("unions") > 0, F.array(F.concat_ws("\n  UNION\n  ", F.transform("unions", lambda g: F.concat(F.lit("{ "), F.concat_ws(" ", F.transform(g, _dot)), F.lit(" }")))))).otherwise(F.array().cast("array<string>")),
            "@status": lambda: _lines("statuses", lambda s: F.concat(F.lit("OPTIONAL { "), main, F.lit(f' {ns}:hasStatusIndicator ?si . FILTER(STR(?si) = "'), s, F.lit('") }'))),
            "@negated": lambda: _lines(F.filter("entities", lambda e: e["negated"]), lambda e: F.concat(F.lit("FILTER NOT EXISTS { "), main, F.lit(f" rdf:type {ns}:"), e["name"], F.lit(" . }"))),
            "@inactive": lambda: _lines(F.filter("entities", lambda e: e["negated"]), lambda e: F.concat(F.lit("FILTER NOT EXISTS { "), variable(e["name"]), F.lit(f' {ns}:hasStatus "inactive" . }}'))),
            "@target": lambda: _lines(F.slice("relations", 1, 1), lambda r: F.concat_ws(" ", main, F.concat(F.lit(ns + ":"), r["name"]), F.lit("?target ."))),
            "@main": lambda: F.when(F.size("entities") > 0, F.array(F.concat(main, F.lit(" ?p ?o .")))).otherwise(F.array().cast("array<string>")),
            "@anything": lambda: F.when(F.size("entities") > 0, F.array(F.concat(F.lit("OPTIONAL { "), main, F.lit(f" ?p ?o . FILTER(STRSTARTS(STR(?p), STR({ns}:))) }}")))).otherwise(F.array().cast("array<string>")),
            "@settings": lambda: _lines("properties", lambda d: F.when(d["value"].isNull(), F.concat(F.lit("OPTIONAL { "), main, F.lit(f" {ns}:"), d["name"], F.lit(" ?"), d["name"], F.lit(" . }"))).otherwise(F.concat(main, F.lit(f" {ns}:"), d["name"], F.lit(" ?"), d["name"], F.lit(" . FILTER(STR(?"), d["name"], F.lit(') = "'), d["value"], F.lit('")')))),
            "@nary": self.nary,
        }
        return F.coalesce(blocks[name](), F.array().cast("array<string>"))

    def nary(self) -> Column:
        """Lines of the n-ary relation of a question, by its kind; none for null."""
        ns, s, o = self.ns, self.main, F.coalesce(self.marks["{e2}"], F.lit("?object"))
        o = F.when(o == "", "?object").otherwise(o)
        role = F.concat(F.lit(ns + ":"), F.try_element_at("relations", F.lit(1))["name"])
        base = F.concat_ws(" ", s, role, o, F.lit("."))
        note = lambda k: F.lit(f"# n-ary {k}")
        extra = F.transform(F.slice("entities", 2, 1 << 20), lambda e: F.concat_ws(" ", s, role, variable(e["name"]), F.lit(".")))
        size = F.try_element_at(F.filter("properties", lambda d: d["name"].isin("hasSpeed", "hasPrice", "hasQuantity")), F.lit(1))["name"]
        context = lambda prop, var: F.concat_ws(" ", s, F.lit(f"{ns}:{prop}"), F.lit(f"{var} ."))
        optional = lambda x: F.concat(F.lit("OPTIONAL { "), x, F.lit(" }"))
        kind = F.col("nary_kind")
        return (
            F.when(kind == "PRECONDITION_CHAIN", F.concat(F.array(note("PRECONDITION_CHAIN")), extra))
            .when(kind == "QUANTIFIED_RELATION", F.array(note("QUANTIFIED_RELATION"), base, F.concat_ws(" ", s, F.concat(F.lit(ns + ":"), size), F.concat(F.lit("?"), size), F.lit("."))))
            .when(kind == "TEMPORAL_CONTEXT", F.array(note("TEMPORAL_CONTEXT"), base, optional(context("hasDate", "?date"))))
            .when(kind == "SPATIAL_CONTEXT", F.array(note("SPATIAL_CONTEXT"), base, optional(context("hasLocation", "?location"))))
            .when(kind == "CONDITIONAL_ROLE", F.concat(F.array(note("CONDITIONAL_ROLE"), base), F.transform("nary", lambda e: F.concat(F.lit("FILTER EXISTS { "), variable(e["name"]), F.lit(f" rdf:type {ns}:"), e["name"], F.lit(" . }")))))
        )


def annotation(text: str, ns: str, extra: dict[str, Column] | None = None) -> Column:
    """The question as a comment on the query's own node, with its intent, type and focus."""
    parts = {"intent": F.col("intent"), "questionType": F.col("q_type"), **(extra or {}), "focusVariable": F.col("focus")}
    typed = [F.concat(F.lit(f'  {ns}:{k} "'), F.coalesce(v, F.lit("")), F.lit('"^^xsd:string')) for k, v in parts.items()]
    return F.concat(F.lit(f'OPTIONAL {{\n  _:queryMeta rdf:type {ns}:SPARQLQuery ;\n  rdfs:comment "'), escaped(F.col(text)), F.lit('"@en ;\n'), F.concat_ws(" ;\n", *typed), F.lit(" .\n  }"))


def prefixes(spaces: list[tuple[str, str]], extra: Column | None = None) -> Column:
    """PREFIX lines of the spaces and the common vocabularies; extra: further lines or null."""
    own = F.lit("\n".join(f"PREFIX {k}: <{v}>" for k, v in spaces))
    return F.concat_ws("\n", own, *([] if extra is None else [extra]), F.lit("\n".join(f"PREFIX {k}: <{v}>" for k, v in VOCABULARIES)))


def dispatched(df: DataFrame, text: str, ns: str, head: Column, templates: dict[str, tuple[Template, ...]] | None = None) -> DataFrame:
    """df with query: the template of the intent (of SELECT_GENERAL for others) whose condition holds first, rendered.

    Needs the columns of description(), and actions and statuses. A null or blank question gives null."""
    templates, row = templates or TEMPLATES, _Row(ns)
    note = annotation(text, ns)

    def one(t: Template) -> Column:
        parts = [row.block(x) if x[0] == "@" else F.array(row.text(x)) for x in t.lines]
        where = F.concat_ws("\n  ", F.concat(*parts, F.array(note)))
        made = F.concat_ws("\n  ", F.concat(*[row.block(x) for x in t.construct])) if t.construct else None
        top = F.concat(F.lit("CONSTRUCT {\n  "), made, F.lit("\n}\nWHERE {\n  ")) if t.construct else F.concat(row.text(t.head), F.lit(" {\n  " if t.head == "ASK" else "\nWHERE {\n  "))
        order = F.concat(F.lit("\nORDER BY "), row.text(t.order)) if t.order else F.lit("")
        return F.concat(head, F.lit("\n"), top, where, F.lit("\n}"), order)

    def chosen(options: tuple[Template, ...]) -> Column:
        out = one(options[-1])
        for t in reversed(options[:-1]):
            out = F.when(F.expr(t.when), one(t)).otherwise(out)
        return out

    out = chosen(templates["SELECT_GENERAL"])
    for k, v in templates.items():
        if k != "SELECT_GENERAL":
            out = F.when(F.col("intent") == k, chosen(v)).otherwise(out)
    return df.withColumn("query", F.when(F.trim(F.col(text)) != "", out))


def fields_select(df: DataFrame, text: str, ns: str, head: Column, subject: str, constants: dict[str, Column], extra: dict[str, tuple[Column, str]], notes: dict[str, Column] | None = None) -> DataFrame:
    """df with query: one SELECT over the projected fields. The first field is bound to the focus, the others are optional; constants are
    literal patterns (left out where null or empty), extra optional literals with their datatype; negations and unions of the
    description follow. A null or blank question gives null."""
    fields = F.col("fields")
    focus = F.coalesce(F.nullif(F.col("focus"), F.lit("")), F.lit("?result"))
    more = F.slice(fields, 2, 2)
    literal = lambda k, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'{subject} {ns}:{k} "'), v, F.lit('" .')))
    optional = lambda k, v, kind: F.when(v.isNotNull(), F.concat(F.lit(f'OPTIONAL {{ {subject} {ns}:{k} "'), escaped(v), F.lit(f'"{kind} . }}')))
    row = _Row(ns)
    lines = F.concat(
        F.filter(F.array(*[literal(k, v) for k, v in constants.items()]), lambda x: x.isNotNull()),
        F.array(F.concat(F.lit(f'{subject} {ns}:description "'), escaped(F.col(text)), F.lit('"@en .')), F.concat(F.lit(f"{subject} {ns}:"), F.coalesce(F.try_element_at(fields, F.lit(1)), F.lit("result")), F.lit(" "), focus, F.lit(" ."))),
        F.transform(more, lambda f: F.concat(F.lit(f"OPTIONAL {{ {subject} {ns}:"), f, F.lit(" ?"), f, F.lit(" . }"))),
        F.filter(F.array(*[optional(k, v, kind) for k, (v, kind) in extra.items()]), lambda x: x.isNotNull()),
        F.transform("not_roles", lambda x: F.concat(F.lit("FILTER NOT EXISTS { "), _dot(x), F.lit(" }"))),
        row.block("@union"),
        F.array(annotation(text, ns, notes)),
    )
    top = F.concat_ws(" ", F.lit("SELECT"), focus, F.concat_ws(" ", F.transform(more, lambda f: F.concat(F.lit("?"), f))), F.lit("WHERE {"))
    return df.withColumn("query", F.when(F.trim(F.col(text)) != "", F.concat(head, F.lit("\n"), F.regexp_replace(top, " +", " "), F.lit("\n  "), F.concat_ws("\n  ", lines), F.lit("\n}"))))


def fallback(text: str, ns: str, head: Column, why: Column) -> Column:
    """The query of a question that could not be built: everything of the name space, twenty rows, with the reason as a comment."""
    return F.concat(head, F.lit("\n# ERROR: "), why, F.lit(f"\nSELECT DISTINCT ?subject ?predicate ?object WHERE {{\n  ?subject ?predicate ?object .\n  FILTER(STRSTARTS(STR(?predicate), STR({ns}:)))\n  "), annotation(text, ns), F.lit("\n} LIMIT 20"))


def diagnostics(df: DataFrame, text: str, columns: dict[str, str], lists: list[str] = ()) -> DataFrame:
    """One flat row per question: columns (name in the output: column) as strings, arrays and structs as JSON; lists are columns kept as they are."""
    plain = {"string", "bigint", "int", "boolean", "double"}
    out = [F.col(c).cast("string").alias(n) if dict(df.dtypes)[c] in plain else F.to_json(c).alias(n) for n, c in columns.items()]
    return df.select(*lists, F.col(text).alias("question"), *out)


def batch(df: DataFrame, text: str, built: str = "query") -> DataFrame:
    """The rows of a run: questions that are null, blank or nan are skipped; where no query came out the intent is ERROR and the query says so."""
    kept = df.filter(~F.coalesce(F.lower(F.trim(F.col(text))).isin("", "nan"), F.lit(True)))
    lost = F.col(built).isNull()
    return kept.withColumns({"intent": F.when(lost, "ERROR").otherwise(F.col("intent")), built: F.when(lost, "# Error: no query").otherwise(F.col(built))})
