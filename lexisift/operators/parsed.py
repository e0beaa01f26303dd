"""Operators over parser annotations: profiles of parts of speech, entities and trees, relations between subjects and objects, and the
triple passes that need a tree.

An annotation is a column tokens: array of (text, lemma, pos, tag, dep, head), head being the index of the governing token from 0 and
a root its own head; and a column ents: array of (label, surface). Both come from a provider (functions/providers.annotated) or are
null, which counts as no tokens."""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..session import spec, spread
from .triples import GATE, Vocabulary, coined, pattern_triples

TOKENS = "array<struct<text:string,lemma:string,pos:string,tag:string,dep:string,head:int>>"
ENTS = "array<struct<label:string,surface:string>>"
# Parts of speech, tags and entity labels that are profiled.
POS = "NOUN VERB ADJ ADV PROPN NUM ADP DET PRON CCONJ SCONJ PUNCT".split()
TAGS = {"pct_VBZ_VBP": ("VBZ", "VBP"), "pct_VBD": ("VBD",), "pct_VBN": ("VBN",)}
LABELS = "ORG PERSON GPE DATE MONEY PERCENT LAW NORP PRODUCT EVENT TIME CARDINAL".split()
# Dependencies of clause heads, subjects and objects.
CLAUSE_HEADS = ("ROOT", "relcl", "advcl", "xcomp", "ccomp", "conj", "acl")
SUBJECTS = ("nsubj", "nsubjpass", "csubj", "csubjpass")
OBJECTS = ("dobj", "pobj", "attr", "ccomp", "xcomp", "oprd", "acomp")
ACTORS, TARGETS = ("nsubj", "nsubjpass"), ("dobj", "attr", "pobj", "oprd")
LOGICAL = {"and": "owl:intersectionOf", "or": "owl:unionOf", "nor": "owl:complementOf", "not": "owl:complementOf"}
NUMERIC = re.compile(r"^\d[\d,\.]*\s*(?:%|percent|basis\s*points?|bps?|days?|months?|years?|weeks?|hours?|usd|eur|gbp|\$|€|£|million|billion|thousand)?$", re.I)
TRIPLES = "subject string, predicate string, object string, confidence double, step string, negated boolean"


@F.pandas_udf(IntegerType())
def tree_depth(heads: pd.Series) -> pd.Series:
    """Longest way from a root to a leaf, in edges; 0 for no tokens."""

    def one(h) -> int:
        if h is None or len(h) == 0:
            return 0
        known = {}

        def depth(i):
            path = []
            while i not in known and h[i] != i and len(path) <= len(h):
                path.append(i)
                i = h[i]
            d = known.setdefault(i, 0)
            for j in reversed(path):
                d += 1
                known[j] = d
            return d

        return max(depth(i) for i in range(len(h)))

    return heads.map(one).astype("int32")


def syntax_features(df: DataFrame, tokens: str = "tokens", ents: str = "ents") -> DataFrame:
    """df with shares of parts of speech and verb tags in per cent, tree depth, passive, counts of entities and their number per token."""
    t, e = F.coalesce(F.col(tokens), F.array().cast(TOKENS)), F.coalesce(F.col(ents), F.array().cast(ENTS))
    n = F.greatest(F.size(t), F.lit(1))
    share = lambda test: F.round(100.0 * F.size(F.filter(t, test)) / n, 2)
    out = {f"pos_{p}": share(functools.partial(lambda p, x: x["pos"] == p, p)) for p in POS}
    out |= {k: share(functools.partial(lambda v, x: x["tag"].isin(*v), v)) for k, v in TAGS.items()}
    out |= {"dep_tree_depth": tree_depth(F.transform(t, lambda x: x["head"])), "has_passive": F.exists(t, lambda x: x["dep"].isin("nsubjpass", "auxpass")).cast("int")}
    out |= {"ne_count": F.size(e), "ne_density": F.round(F.size(e) / n, 4)}
    out |= {f"ne_{k}": F.size(F.filter(e, functools.partial(lambda k, x: x["label"] == k, k))) for k in LABELS}
    return df.withColumns(out)


def syntax_profiles(df: DataFrame, group: str) -> DataFrame:
    """(group, n, mean_*) of the columns of syntax_features, and mean and deviation of tree depth and passives."""
    names = [f"pos_{p}" for p in POS] + list(TAGS) + ["ne_count"] + [f"ne_{k}" for k in LABELS]
    aggs = [F.round(F.avg(c), 3).alias(f"mean_{c}") for c in names] + [F.round(F.avg("ne_density"), 4).alias("mean_ne_density")]
    for c in ("dep_tree_depth", "has_passive"):
        aggs += [F.round(F.avg(c), 3).alias(f"mean_{c}"), F.round(F.stddev_samp(c), 3).alias(f"std_{c}")]
    return df.groupBy(group).agg(F.count("*").alias("n"), *aggs)


class Tree:
    """Tokens of a text with their children in order."""

    def __init__(self, tokens: list[dict]):
        self.t = tokens
        self.kids: list[list[int]] = [[] for _ in tokens]
        for i, x in enumerate(tokens):
            if x["head"] != i and 0 <= x["head"] < len(tokens):
                self.kids[x["head"]].append(i)

    def under(self, i: int, deps) -> list[int]:
        return [k for k in self.kids[i] if self.t[k]["dep"] in deps]

    def denied(self, i: int) -> bool:
        return bool(self.under(i, ("neg",)))

    def phrase(self, i: int) -> str:
        """The noun with its compounds, and nouns that modify it from the left."""
        noun = lambda k: self.t[k]["pos"] in ("NOUN", "PROPN")
        parts = [k for k in self.kids[i] if noun(k) and (self.t[k]["dep"] in ("compound", "flat") or k < i and self.t[k]["dep"] == "amod")]
        return " ".join(self.t[k]["text"] for k in sorted([*parts, i]))

    def span(self, i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += self.kids[k]
        return sorted(out)


def named(surface: str, names: dict[str, str], negated: bool = False) -> str:
    """Name of a relation or property: the longest known surface in it, coined otherwise; doesNotX for a negated known one."""
    low = surface.lower().strip()
    hit = next((k for k in sorted(names, key=lambda k: -len(k)) if k in low), None)
    if hit is None:
        return coined(surface[:20])
    name = names[hit]
    return "doesNot" + name[:1].upper() + name[1:] if negated else name


def verb_pass(tree: Tree, voc: Vocabulary, names: dict[str, str]):
    """Subject and objects of each clause's verb; an open complement without a subject takes that of its head."""
    for i, x in enumerate(tree.t):
        if x["pos"] not in ("VERB", "AUX") or x["dep"] not in ("ROOT", "xcomp", "ccomp", "relcl", "advcl", "conj"):
            continue
        subject = tree.under(i, ACTORS) or (tree.under(x["head"], ACTORS) if x["dep"] == "xcomp" and x["head"] != i else [])
        if not subject:
            continue
        s, sc = voc.resolve(tree.phrase(subject[0]))
        targets = tree.under(i, TARGETS) + [o for p in tree.under(i, ("prep",)) for o in tree.under(p, ("pobj",))]
        for o, oc in (voc.resolve(tree.phrase(k)) for k in targets):
            if sc >= GATE and oc >= GATE:
                yield s, named(x["lemma"], names, tree.denied(i)), o, round((sc + oc) / 2, 3), "verb", tree.denied(i)


def attribute_pass(tree: Tree, voc: Vocabulary, properties: dict[str, str], qualifiers: frozenset):
    """Numbers and qualifiers that modify a known noun become data values; the confidence is the noun's times 0.85."""
    for x in tree.t:
        low = x["text"].lower()
        if x["dep"] in ("amod", "nummod", "npadvmod", "quantmod") and (NUMERIC.match(low) or low in qualifiers):
            s, sc = voc.resolve(tree.phrase(x["head"]))
            c = round(sc * 0.85, 3)
            if sc >= GATE and c >= GATE:
                hit = next((k for k in sorted(properties, key=lambda k: -len(k)) if k in low), None)
                yield s, properties[hit] if hit else "has" + coined(low[:20]).capitalize(), f'"{x["text"]}"', c, "attribute", False


def logical_pass(tree: Tree, voc: Vocabulary):
    """Two known nouns joined by a conjunction: intersection for and, union for or, complement for nor."""
    for i, x in enumerate(tree.t):
        if x["dep"] == "conj":
            a, ac = voc.resolve(tree.phrase(x["head"]))
            b, bc = voc.resolve(tree.phrase(i))
            if ac >= GATE and bc >= GATE and a != b:
                cc = tree.under(x["head"], ("cc",))
                yield a, LOGICAL.get(tree.t[cc[0]]["text"].lower() if cc else "and", "owl:intersectionOf"), b, round((ac + bc) / 2, 3), "logical", False


def general_pass(tree: Tree):
    """Lemmas of subject, verb and objects without a vocabulary; confidence 0.70."""
    for i, x in enumerate(tree.t):
        subject = tree.under(i, ACTORS)
        if x["pos"] in ("VERB", "AUX") and subject:
            for k in tree.under(i, TARGETS):
                no = tree.denied(i)
                yield "ent:" + tree.t[subject[0]]["lemma"].lower().replace(" ", "_"), "rel:" + "neg_" * no + x["lemma"].lower(), "ent:" + tree.t[k]["lemma"].lower().replace(" ", "_"), 0.70, "general", no


def relations(tokens: list[dict], entities: list[tuple[str, str]], verbs: dict[str, str]) -> list[tuple[str, str, str, bool]]:
    """(s, p, o, negated) of the clauses of a question, one per predicate: s and o are variables of entities (surface, name) where the
    token, or what hangs on it, names one, else of the lemma. Missing subjects and objects are the first and second entity."""
    tree, out = Tree(tokens), {}
    var = lambda n: "?" + n[:1].lower() + n[1:]
    of = {i: next((n for s, n in entities if x["text"].lower() in s or s in x["text"].lower()), None) for i, x in enumerate(tokens)}

    def term(i: int) -> str:
        if of[i]:
            return var(of[i])
        inside = " ".join(tokens[k]["text"].lower() for k in tree.span(i) if tokens[k]["pos"] != "PUNCT")
        hit = next((n for s, n in entities if s in inside or inside in s), None)
        clean = re.sub(r"[^a-zA-Z0-9]", "_", tokens[i]["lemma"].strip())
        return var(hit) if hit else var(clean if clean and not clean[0].isdigit() else "x" + clean)

    for i, x in enumerate(tokens):
        if x["pos"] == "VERB" and x["dep"] in CLAUSE_HEADS:
            lemma = x["lemma"].lower()
            p = verbs.get(lemma, lemma)
            if p in out:
                continue
            subject, target, prep = tree.under(i, SUBJECTS), tree.under(i, OBJECTS), tree.under(i, ("prep",))
            s = term(subject[0]) if subject else var(entities[0][1]) if entities else "?subject"
            if not target and prep:
                target = tree.under(prep[0], ("pobj",)) or prep[:1]
            o = term(target[0]) if target else var(entities[1][1]) if len(entities) > 1 else "?answer"
            out[p] = (s, p, o, tree.denied(i))
    return list(out.values())


def question_relations(df: DataFrame, entities: str, verbs: dict[str, str], tokens: str = "tokens", out: str = "spo") -> DataFrame:
    """df with the relations of its questions. entities: column of structs with surface and name. All columns pass through."""
    from .transform import SPO

    src = spread(df)
    names = df.columns

    def run(batches):
        for b in batches:
            rows = []
            for t, e in zip(b.column(names.index(tokens)).to_pylist(), b.column(names.index(entities)).to_pylist()):
                rows.append([{"s": s, "p": p, "o": o, "negated": n} for s, p, o, n in relations(t or [], [(x["surface"], x["name"]) for x in e or []], verbs)])
            kind = pa.list_(pa.struct([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("negated", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*names, out])

    return src.mapInArrow(run, f"{spec(src, names)}, `{out}` {SPO}")


def tree_triples(df: DataFrame, keys: list[str], surfaces: dict[str, str], names: dict[str, str], properties: dict[str, str], qualifiers=(), blocked=(), tokens: str = "tokens", general: bool = False, text: str | None = None) -> DataFrame:
    """(keys, subject, predicate, object, confidence, step, negated): triples of annotated texts by verb, attribute and logical passes, or
    by the general one. With text, those of connecting phrases and causal verbs are found too, after the verbs' and after the
    conjunctions'. Equal triples of a text stay once, the first; ordered by confidence, stable. Null annotations give none."""
    src = spread(df.select(*keys, tokens, *([text] if text else [])))
    k = len(keys)

    def run(batches):
        voc = Vocabulary(surfaces, frozenset(blocked))
        some = frozenset(qualifiers)
        for b in batches:
            at, rows = [], []
            texts = b.column(k + 1).to_pylist() if text else [None] * b.num_rows
            for i, (t, said) in enumerate(zip(b.column(k).to_pylist(), texts)):
                tree, seen = Tree(t or []), {}
                plain = [(*x, False) for x in pattern_triples(said, voc)] if said else []
                of = lambda step: [x for x in plain if x[4] == step]  # noqa: B023, E731
                passes = (general_pass(tree),) if general else (verb_pass(tree, voc, names), of("structural"), attribute_pass(tree, voc, properties, some), logical_pass(tree, voc), of("causal"))
                for p in passes:
                    for x in p:
                        seen.setdefault(x[:3], x)
                at += [i] * len(seen)
                rows += sorted(seen.values(), key=lambda x: -x[3])
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int32())) for c in b.columns[:k]], *[pa.array(c, x) for c, x in zip(cols, kinds)]], [*keys, "subject", "predicate", "object", "confidence", "step", "negated"])

    return src.mapInArrow(run, f"{spec(src, keys)}, {TRIPLES}")
