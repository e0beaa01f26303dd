"""Triples from sentences by patterns, against a vocabulary given as data; density, counts and rankings of extractors."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, spec, spread

CONFIDENT = 0.75
GATE = 0.60
# Connecting phrases with their predicates.
CONNECTIONS = {
    r"governed\s+by": "governedBy", r"regulated\s+by": "regulatedBy", r"supervised\s+by": "supervisedBy", r"subject\s+to": "subjectTo", r"covered\s+by": "coveredBy", r"owned\s+by": "ownedBy",
    r"controlled\s+by": "controlledBy", r"affiliated\s+with": "affiliatedWith", r"provided\s+by": "providedBy", r"issued\s+by": "issuedBy", r"part\s+of": "partOf", r"falls?\s+under": "fallsUnder",
    r"belongs?\s+to": "belongsTo", r"defined\s+as": "definedAs", r"classified\s+as": "type", r"considered\s+(?:a|an)": "type", r"is\s+(?:a|an)": "type", r"are\s+(?:a|an)": "type",
}
# Causal verbs, in either number, with their predicates; words that name no entity.
CAUSES = {"lead": "leadsTo", "result": "resultsIn", "trigger": "triggers", "cause": "hasCause", "drive": "drives", "produce": "produces", "increase": "increases", "decrease": "decreases", "reduce": "reduces"}
_CAUSAL = re.compile(r"(?P<s>[A-Za-z ]{3,45}?)\s+(?P<v>leads?\s+to|results?\s+in|triggers?|causes?|drives?|produces?|increases?|decreases?|reduces?)\s+(?P<o>[A-Za-z ]{3,45})", re.I)
BLOCKED = frozenset(
    "i me my we our you your he him his she her it its they them their who whom whose which that this these those there here one ones each both all none any anyone anything someone something "
    "everyone everything nobody nothing is are was were be been being have has had do does did will would could should may might must can shall no every few many much some several most such other another same".split()
)
_LINKS = re.compile(r"\b(?:" + "|".join(f"(?P<p{i}>{p})" for i, p in enumerate(CONNECTIONS)) + r")\b", re.I)
_PREDICATES = list(CONNECTIONS.values())


def coined(text: str) -> str:
    """A name from any text: words of letters and digits, the first small, the others with a capital."""
    first, *rest = re.findall("[a-zA-Z0-9]+", text) or ["x"]
    return first.lower() + "".join(w.capitalize() for w in rest)


class Vocabulary:
    """Surface forms with their names. Confidence: 0.95 exact; 0.85 the longest contained form of four letters or more; then by words of four
    letters or more from the left, 0.75 the word, 0.70 its singular; 0.40 coined. 0 for blocked words and texts below three letters."""

    def __init__(self, surfaces: dict[str, str], blocked: frozenset = BLOCKED):
        self.exact = {k.lower(): v for k, v in surfaces.items()}
        self.blocked = blocked
        self.longest = sorted((k for k in self.exact if len(k) >= 4), key=len, reverse=True)
        forms = sorted(self.exact, key=lambda k: (-len(k), k))
        self.any_form = re.compile("|".join(map(re.escape, forms))) if forms else re.compile(r"(?!)")
        self.forms = [(k, re.compile(rf"(?<!\w){re.escape(k)}(?!\w)")) for k in forms]

    def resolve(self, text: str) -> tuple[str, float]:
        key = " ".join(text.lower().split())
        if key in self.blocked or len(key) < 3:
            return coined(key), 0.0
        if key in self.exact:
            return self.exact[key], 0.95
        if self.any_form.search(key):
            inside = next((k for k in self.longest if k in key), None)
            if inside:
                return self.exact[inside], 0.85
            for w in key.split():
                if len(w) >= 4 and w not in self.blocked:
                    for form, c in ((w, 0.75), (w[:-1] if w[-1] == "s" else "", 0.70)):
                        if form in self.exact:
                            return self.exact[form], c
        return coined(text[:24]), 0.40

    def spans(self, text: str) -> list[tuple[int, int, str, bool]]:
        """(start, end, name, negated) of all occurrences, longest forms first, none overlapping another; negated if a negation stands in
        the twenty characters before."""
        low, taken, out = text.lower(), bytearray(len(text.lower())), []
        if not self.any_form.search(low):
            return out
        for k, p in self.forms:
            if k in low:
                for m in p.finditer(low):
                    if not any(taken[m.start() : m.end()]):
                        taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                        out.append((m.start(), m.end(), self.exact[k], bool(re.search(r"\b(?:no|not|without|never|cannot|can't)\b", low[max(0, m.start() - 20) : m.start()]))))
        return sorted(out)


def _nearest(voc: Vocabulary, words: list[str], left: bool) -> tuple[str, float]:
    """The entity of the three, two or one words next to a phrase, whichever is known first."""
    got = (voc.resolve(" ".join(words[-n:] if left else words[:n])) for n in (3, 2, 1))
    return next((x for x in got if x[1] >= GATE), ("", 0.0))


def pattern_triples(text: str, voc: Vocabulary) -> list[tuple[str, str, str, float, str]]:
    """(subject, predicate, object, confidence, pass) of a text: connecting phrases, then causal verbs, per sentence; each phrase counts once
    a sentence. Of equal triples the first stays; ordered by confidence, stable."""
    sentences = re.split(r"(?<=[.!?])\s+", text or "")
    found: dict[tuple, tuple] = {}

    def add(s, p, o, step):
        if s[1] >= GATE and o[1] >= GATE:
            found.setdefault((s[0], p, o[0]), (s[0], p, o[0], round((s[1] + o[1]) / 2, 3), step))

    for sent in sentences:
        hits: dict[int, re.Match] = {}
        for m in _LINKS.finditer(sent):
            hits.setdefault(int(m.lastgroup[1:]), m)
        for i in sorted(hits):
            m = hits[i]
            after = re.split("[,;]", sent[m.end() :].strip(), maxsplit=1)[0]
            add(_nearest(voc, sent[: m.start()].split(), True), _PREDICATES[i], _nearest(voc, after.split(), False), "structural")
    for sent in sentences:
        for m in _CAUSAL.finditer(sent):
            verb = m["v"].split()[0].lower()
            add(voc.resolve(m["s"].strip()), CAUSES.get(verb) or CAUSES.get(verb[:-1], "leadsTo"), voc.resolve(m["o"].strip()), "causal")
    return sorted(found.values(), key=lambda t: -t[3])


def extract(df: DataFrame, keys: list[str], text: str, surfaces: dict[str, str]) -> DataFrame:
    """(keys, subject, predicate, object, confidence, step): triples of each text, read whole. surfaces is a vocabulary of bounded size."""
    head = spec(df, keys)
    k = len(keys)

    def run(batches):
        voc = Vocabulary(surfaces)
        for b in batches:
            at, rows = [], []
            for i, v in enumerate(b.column(k)):
                for t in pattern_triples(v.as_py(), voc):
                    at.append(i)
                    rows.append(t)
            idx, cols = pa.array(at, pa.int32()), list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*[c.take(idx) for c in b.columns[:k]], *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))]], [*keys, "subject", "predicate", "object", "confidence", "step"])

    return spread(df.select(*keys, text)).mapInArrow(run, f"{head}, subject string, predicate string, object string, confidence double, step string")


def entity_spans(df: DataFrame, keys: list[str], text: str, surfaces: dict[str, str]) -> DataFrame:
    """(keys, start, end, name, negated): vocabulary entities of each text."""
    head = spec(df, keys)
    k = len(keys)

    def run(batches):
        voc = Vocabulary(surfaces)
        for b in batches:
            at, rows = [], []
            for i, v in enumerate(b.column(k)):
                for t in voc.spans(v.as_py() or ""):
                    at.append(i)
                    rows.append(t)
            idx, cols = pa.array(at, pa.int32()), list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*[c.take(idx) for c in b.columns[:k]], *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.bool_()))]], [*keys, "start", "end", "name", "negated"])

    return spread(df.select(*keys, text)).mapInArrow(run, f"{head}, start int, end int, name string, negated boolean")


def contained_form(df: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """df with the longest vocabulary surface contained in the text, the first in order on ties; null without one.

    The vocabulary is collected to a literal; it must be a small dictionary (at most 10,000 surfaces, checked)."""
    rows = vocabulary.select("surface").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the vocabulary holds more than 10,000 surfaces")
    forms = F.array(*[F.lit(r["surface"]) for r in sorted(rows, key=lambda r: (-len(r["surface"]), r["surface"]))]) if rows else F.array().cast("array<string>")
    return df.withColumn("form", F.try_element_at(F.filter(forms, lambda s: F.contains(F.lower(F.col(text)), s)), F.lit(1)))


def tkf(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each metric per key, four decimals, missing as 0."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.coalesce(f(m), F.lit(0.0)), 4).alias(f"{m}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def extractor_pivot(df: DataFrame, key: str, columns: list[str], score: str, name: str) -> DataFrame:
    """(key, one mean per column value, best, best_score, spread) and a row MEAN over all rows of each column value."""
    wide = df.groupBy(key).pivot(name, columns).agg(F.avg(score))
    whole = df.groupBy().pivot(name, columns).agg(F.avg(score)).select(F.lit("MEAN").alias(key), *columns)
    both = wide.unionByName(whole)
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)]), lambda x: x["s"].isNotNull()))
    first = F.try_element_at(ranked, F.lit(1))
    return both.select(key, *[F.round(c, 4).alias(c) for c in columns], first["c"].alias("best"), F.round(-first["s"], 4).alias("best_score"), F.round(F.greatest(*columns) - F.least(*columns), 4).alias("spread"))


def leaderboard(df: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """df with its rank by score, descending; ties by the given columns. The table must be a summary: ranks need one order over all rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), *ties)))


def density_by_method(responses: DataFrame, keys: list[str], method: str, text: str, triples: DataFrame, gold: DataFrame, query: str) -> DataFrame:
    """(keys, method, triple_count_c, triple_count_g, ratio_c_over_g, kd, missing) per response: triples found in it, those of the reference
    answer of its query, their ratio (null without any of the latter), typed triples per word, and whether the response is missing.

    triples: keys, method, confidence; gold: query, one row per triple of the reference. Both are counted before they are joined."""
    from ..functions.questions import density
    from ..functions.values import is_missing_text

    found = triples.groupBy(*keys, method).agg(F.count("*").alias("_c"), F.count_if(F.col("confidence") >= CONFIDENT).alias("_typed"))
    ref = gold.groupBy(query).agg(F.count("*").alias("triple_count_g"))
    j = responses.join(found, [*keys, method], "left").join(ref, query, "left").na.fill(0, ["_c", "_typed", "triple_count_g"])
    missing = is_missing_text(F.col(text))
    c = F.when(missing, 0).otherwise(F.col("_c"))
    j = j.select(*keys, query, method, c.alias("triple_count_c"), "triple_count_g", F.round(F.try_divide(c.cast("double"), F.col("triple_count_g").cast("double")), 4).alias("ratio_c_over_g"), F.when(missing, 0.0).otherwise(density(F.col("_typed"), F.col(text))).alias("kd"), missing.alias("missing"))
    return j


def numbered(df: DataFrame, column: str, order: list[str], out: str = "query_id", buckets: int = 1024) -> DataFrame:
    """df with out: the trimmed text of a column, or the row's number from 1 in the given order where it is null or blank.

    Numbers are prefix sums over ranges of the order, so no task sorts all rows."""
    src = df.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id())
    src = durable(src)
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    base = src.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    j = src.withColumn("_i", inside).join(F.broadcast(base), "_p")  # one row a range
    given = F.trim(F.col(column).cast("string"))
    return j.withColumn(out, F.when(F.coalesce(given, F.lit("")) != "", given).otherwise((F.col("_i") + F.col("_off")).cast("string"))).drop("_p", "_i", "_off")
