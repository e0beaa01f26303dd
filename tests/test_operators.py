import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.operators import algebra, builders, corpus, harness, latent, pairing, parsed, profiles, stats, transform, triples
from lexisift.plans import rules as R
from lexisift.sources import sinks, tables


def ranks(xs):
    s = sorted(xs)
    return {x: sum(i + 1 for i, y in enumerate(s) if y == x) / s.count(x) for x in set(xs)}


def test_average_ranks(spark):
    rng = random.Random(3)
    xs = [rng.randint(0, 40) / 4 for _ in range(400)]
    df = spark.createDataFrame([("m", x) for x in xs], "metric string, x double")
    got = {r["x"]: r["rank"] for r in stats.average_ranks(df, ["metric"], "x").collect()}
    assert got == pytest.approx(ranks(xs))


def test_kruskal_against_definition(spark):
    rng = random.Random(5)
    rows = [(g, float(rng.randint(0, 9) + (g == "c") * 2)) for g in "abc" for _ in range(20)] + [("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("flat", F.lit(1.0))
    r = {x["metric"]: x for x in stats.kruskal(df, ["x", "flat"], "g").collect()}
    vals = [(g, x) for g, x in rows if g != "d"]
    rk, n = ranks([x for _, x in vals]), 60
    s = sum(sum(rk[x] for g, x in vals if g == k) ** 2 / 20 for k in "abc")
    t = sum(c**3 - c for c in Counter(x for _, x in vals).values())
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n**3 - n))
    assert r["x"]["h"] == pytest.approx(h, abs=1e-3) and r["x"]["k"] == 3 and r["x"]["p"] == pytest.approx(math.exp(-h / 2), abs=1e-5)
    assert r["flat"]["significant"] == "Skipped" and r["flat"]["h"] is None


def test_wilcoxon_and_exact(spark):
    d = [1.0, -2.0, 3.0, 4.0, 5.0, -6.0, 7.0, 0.0, float("nan")]
    df = spark.createDataFrame([("g", x) for x in d], "g string, d double")
    r = stats.wilcoxon(df, ["g"], "d").first()
    assert (r["n_nonzero"], r["w_plus"], r["w_minus"]) == (7, 20.0, 8.0)
    n, stat = 7, 8
    ways = sum(sum(c) <= stat for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k))
    assert stats.exact_wilcoxon_p(n, stat) == pytest.approx(min(1, 2 * ways / 2**n))


def test_wilcoxon_is_exact_for_small_groups(spark):
    d = [1.0, -2.0, 3.0, 4.0, 5.0, -6.0, 7.0]
    rows = [("plain", x) for x in d] + [("zero", x) for x in [*d, 0.0]] + [("tied", x) for x in [*d, 7.0]] + [("few", 1.0)]
    r = {x["g"]: x for x in stats.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert r["plain"]["p"] == pytest.approx(stats.exact_wilcoxon_p(7, 8), abs=1e-6) and r["few"]["p"] is None
    assert r["zero"]["z"] == r["plain"]["z"] and r["zero"]["p"] != r["plain"]["p"]
    for g in ("zero", "tied"):
        assert r[g]["p"] == pytest.approx(math.erfc(abs(r[g]["z"]) / math.sqrt(2)), abs=1e-4)


def test_bootstrap(spark):
    v = list(np.random.default_rng(1).normal(size=50))
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)] + [("s", 0, 2.0)], "g string, i int, v double")
    r = {x["g"]: x for x in stats.bootstrap_ci(df, ["g"], "v", "i").collect()}
    se = np.std(v) / np.sqrt(50)
    assert r["g"]["mean"] == pytest.approx(np.mean(v)) and r["g"]["lo"] == pytest.approx(np.mean(v) - 1.96 * se, abs=0.25 * se) and r["g"]["hi"] == pytest.approx(np.mean(v) + 1.96 * se, abs=0.25 * se)
    # one scheme: many buckets give an interval of the same kind
    many = {x["g"]: x for x in stats.bootstrap_ci(df, ["g"], "v", per_bucket=7).collect()}
    assert many["g"]["n"] == 50 and many["g"]["hi"] - many["g"]["lo"] == pytest.approx(r["g"]["hi"] - r["g"]["lo"], rel=0.15)
    again = {x["g"]: x for x in stats.bootstrap_ci(df.repartition(5), ["g"], "v", per_bucket=7).collect()}
    assert many["g"]["lo"] == pytest.approx(again["g"]["lo"])
    assert r["s"]["lo"] == r["s"]["hi"] == 2.0


def test_self_bleu_is_the_naive_one(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 7))] for _ in range(12)]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(docs)], "id int, g string, t array<string>")
    got = corpus.self_bleu(df, "id", "g", F.col("t")).first()["self_bleu"]
    scores = []
    for i, t in enumerate(docs):
        if not t:
            continue
        rest = docs[:i] + docs[i + 1 :]
        top = Counter()
        for o in rest:
            top |= Counter(o)
        hit = sum(min(c, top[w]) for w, c in Counter(t).items())
        ref = min((abs(len(o) - len(t)), len(o)) for o in rest)[1]
        scores.append(round(hit / len(t) * (1 if len(t) >= ref else math.exp(1 - ref / len(t))), 4))
    assert got == pytest.approx(sum(scores) / len(scores), abs=2e-4)


def test_mean_jaccard_takes_all_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 6))) for _ in range(40)] + [None, None]
    rows = [("g", t) for t in texts] + [("one", "a"), ("void", None), ("void", "a"), (None, "a"), (None, "a")]
    df = spark.createDataFrame(rows, "g string, t string")
    tokens = F.regexp_extract_all(F.lower("t"), F.lit(r"[a-z_]\w*"), F.lit(0))
    sims = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in itertools.combinations([set(t.split()) for t in texts if t is not None], 2)]
    for block in (3, 2048):
        got = {r["g"]: r for r in corpus.mean_jaccard(df, "g", tokens, block).collect()}
        assert set(got) == {"g", "void"} and (got["void"]["n"], got["void"]["jaccard_mean"]) == (1, None)
        assert got["g"]["n"] == math.comb(42, 2) and got["g"]["jaccard_mean"] == pytest.approx(sum(sims) / len(sims))


def test_lexical_diversity_streams_as_defined(spark):
    rng = random.Random(4)
    docs = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 30))] for _ in range(9)]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(docs)], "id int, g string, t array<string>")
    r = corpus.lexical_diversity(df, "id", "g", F.col("t"), window=20).first()
    flat = [w for t in docs for w in t]
    spans = [len(set(flat[i : i + 20])) / 20 for i in range(len(flat) - 19)]
    assert r["corpus_mattr"] == pytest.approx(sum(spans) / len(spans), abs=1e-4)
    few = corpus.corpus_mattr(corpus.numbered_tokens(df.select("g", "id", "t"), 3), 20, chunk=50).first()
    assert few["mattr"] == pytest.approx(sum(spans) / len(spans))
    # worked by hand: "a b a" falls to 2/3, and so does each further three tokens, in both directions; twelve tokens in four factors
    hand = spark.createDataFrame([(1, "h", list("abaaba")), (2, "h", list("abaaba")), (3, "k", list("abcdefghij"))], "id int, g string, t array<string>")
    m = {x["g"]: x["corpus_mtld"] for x in corpus.lexical_diversity(hand, "id", "g", F.col("t")).collect()}
    assert m == {"h": 3.0, "k": 10.0}


def test_intra_cosine_closed_form(spark):
    v = np.random.default_rng(0).normal(size=(8, 5))
    df = spark.createDataFrame([("g", [float(x) for x in r]) for r in v] + [("one", [1.0] * 5)], "g string, e array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = [float(u[i] @ u[j]) for i, j in itertools.combinations(range(8), 2)]
    r = {x["g"]: x["cosine_mean"] for x in corpus.intra_cosine(df, "g", "e").collect()}
    assert r["g"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-4) and r["one"] is None


def test_wasserstein_of_shift(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 3))
    df = spark.createDataFrame([("a", [float(x) for x in r]) for r in a] + [("b", [float(x) for x in r]) for r in a], "g string, e array<double>")
    dirs = corpus.directions(10, 3)
    assert corpus.sliced_wasserstein(df, "g", "e", dirs).first()["wasserstein"] == 0.0
    moved = df.withColumn("e", F.when(F.col("g") == "b", F.transform("e", lambda x: x + 1.0)).otherwise(F.col("e")))
    assert corpus.sliced_wasserstein(moved, "g", "e", dirs).first()["wasserstein"] == pytest.approx(float(np.abs(dirs.sum(1)).mean()), abs=2e-3)


def pairs_fixture(spark):
    rows = [("d", "m", "nlq", "1", 1.0), ("d", "m", "nlq", "1", 3.0), ("d", "m", "sparql", "1", 5.0), ("d", "m", "nlq_cot", "1", 1.0), ("d", "m", "nlq", "2", 0.0), ("d", "m", "sparql", "2", 1.0), ("d", "m", "sparql", "3", None), ("d", "m", "nlq", "3", float("nan"))]
    return spark.createDataFrame(rows, "domain string, model string, method string, query_id string, x double")


def test_win_rates(spark):
    plain = pairing.win_rates(pairing.aligned(pairs_fixture(spark), "x")).first()
    assert (plain["n_sparql"], plain["wr_sparql"], plain["n_nlq_cot"], plain["wr_nlq_cot"], plain["wr_sparql_cot"]) == (2, 100.0, 1, 0.0, None)
    assert (plain["best"], plain["runner_up"], plain["delta_best"]) == ("sparql", "nlq_cot", 100.0)
    logged = pairing.win_rates(pairing.aligned(pairs_fixture(spark), "x", log=True)).first()
    assert logged["n_sparql"] == 1


def test_empty_inputs(spark):
    df = pairs_fixture(spark).limit(0)
    assert pairing.win_rates(pairing.aligned(df, "x")).count() == 0
    assert pairing.win_regions(pairing.aligned(df, "x")).count() == 0
    assert stats.kruskal(df.withColumnRenamed("method", "g"), ["x"], "g").count() == 0


def test_zscores_constant_feature(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "i int, a double, b double")
    assert [(r["a"], r["b"]) for r in latent.zscores(df, ["a", "b"]).orderBy("i").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_impute_majority(spark):
    df = spark.createDataFrame([(1, 1.0, None, None, 1.0, 1.0), (2, None, None, float("nan"), 1.0, 1.0)], "i int, a double, b double, c double, d double, e double")
    assert [tuple(r) for r in latent.impute(df, list("abcde")).collect()] == [(1, 1.0, 0.0, 0.0, 1.0, 1.0)]


def test_representatives_break_ties_by_id(spark):
    df = spark.createDataFrame([(3, "d", "s", 1.0), (1, "d", "s", 3.0), (2, "d", "s", 2.0), (9, "e", "s", 1.0), (8, "e", "s", 1.0)], "id int, domain string, level string, complexity_score double")
    r = {x["domain"]: x["id"] for x in profiles.representatives(df, "id").collect()}
    assert r == {"d": 2, "e": 8}


def test_pending_and_truth(spark):
    todo = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    done = spark.createDataFrame([(2,), (None,)], "k int")
    assert sorted([r[0] or 0 for r in harness.pending(todo, done, "k").collect()]) == [0, 1]
    q = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, " "), (3, 1, None)], "k int, at int, t string")
    assert {r["k"]: r["t"] for r in harness.last_truth(q, "k", "t", "at").collect()} == {1: "new", 2: "[EMPTY]", 3: "[EMPTY]"}


def test_response_union_takes_first_question(spark):
    df = spark.createDataFrame([(1, "sparql", "from sparql", "a"), (1, "nlq", " ", "b"), (2, "nlq_cot", None, None)], "query_id int, method string, question string, response string")
    r = {x["query_id"]: x for x in harness.response_union(df).collect()}
    assert r[1]["question"] == "from sparql" and r[1]["nlq_response"] == "b" and r[2]["question"] is None


def test_generate_retries(spark):
    calls = []

    def failing(texts):
        raise RuntimeError("down")

    df = spark.createDataFrame([("x",)], "t string")
    assert harness.generate(df, failing, "t").first()["generated_response"].startswith("ERROR")
    assert harness.generate(df, lambda ts: [t.upper() for t in ts], "t").first()["generated_response"] == "X"
    assert harness.generate(df, None, "t").first()["generated_response"] is None and not calls


VOC = triples.Vocabulary({"bank": "Bank", "central bank": "CentralBank", "capital rule": "CapitalRule", "loans": "Loan", "risk": "Risk"}, frozenset({"the"}))


def test_vocabulary():
    assert VOC.resolve("central bank") == ("CentralBank", 0.95)
    assert VOC.resolve("the big central banks") == ("CentralBank", 0.85)
    assert VOC.resolve("the") == ("the", 0.0) and VOC.resolve("of") == ("of", 0.0)
    assert VOC.resolve("odd thing") == ("oddThing", 0.40)
    short = triples.Vocabulary({"fee": "Fee", "rule": "Rule", "line": "Line"}, frozenset())
    assert short.resolve("late fee") == ("lateFee", 0.40)  # words below four letters are no entity by themselves
    assert short.resolve("two lines") == ("Line", 0.85)
    assert triples.Vocabulary({"fees due": "Due", "bond": "Bond", "notes": "Notes"}).resolve("some Bond-like thing") == ("Bond", 0.85)
    assert [(s[2], s[3]) for s in VOC.spans("No central bank, but a bank")] == [("CentralBank", True), ("Bank", False)]


def test_pattern_triples():
    got = triples.pattern_triples("The bank is regulated by the central bank, as known. Risk leads to loans.", VOC)
    assert ("Bank", "regulatedBy", "CentralBank") in [t[:3] for t in got] and any(t[1] == "leadsTo" for t in got)
    assert triples.pattern_triples(None, VOC) == [] and triples.pattern_triples("", VOC) == []


def test_algebra(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("a", "r", "a"), ("d", "p", "b")], "s string, p string, o string")
    sol = algebra.bgp(t, ("?x", "p", "?y"), ("?y", "q", "?z"))
    assert sorted(tuple(r) for r in sol.select("x", "z").collect()) == [("a", "c"), ("d", "c")]
    assert [r["x"] for r in algebra.pattern(t, "?x", "r", "?x").collect()] == ["a"]
    assert [r["x"] for r in algebra.not_exists(sol, algebra.pattern(t, "?x", "r", "?w")).collect()] == ["d"]
    assert algebra.ask(algebra.pattern(t, "z", "p", "?y")).first()[0] is False
    with pytest.raises(ValueError):
        algebra.bgp(t, ("?x", "p", "?y"), ("?v", "q", "?w"))
    assert algebra.construct(sol, ("?x", "to", "?z")).count() == 2


def described(spark, rows, entities, relations, properties=None, prefix="qa"):
    df = spark.createDataFrame(rows, "i int, question string").withColumn("t", transform.folded(F.col("question")))
    lf = transform.logical_form(df, "t", transform.first_label(F.col("t"), R.QUESTION_FORMS["telco"], "POLAR"), transform.first_label(F.col("t"), R.INTENTS["telco"], "SELECT_GENERAL"), entities, relations, properties or {}, R.FOCUS_BY_FORM["telco"], {}, "?answer")
    return transform.description(lf.withColumns({"actions": transform.labels_found(F.col("t"), R.ACTIONS), "statuses": transform.status_indicators(F.col("t"), R.LIGHTS, R.COLOURS)}), prefix, "associatedWith", statuses="statuses")


def test_templates_by_intent(spark):
    voc, rel = {"router": "Router", "hub": "Hub", "modem": "Modem", "line": "Line", "plan": "Plan"}, {"work": "worksWith", "require": "requires", "need": "requires"}
    rows = [
        (1, "Is the router not compatible with the hub?"), (2, "Why is the router light blinking red?"), (3, "What are the requirements of every hub?"), (4, "When does my contract end?"), (5, "Can I cancel my contract?"),
        (6, "How do I reset the modem?"), (7, "Is there a fault on the line?"), (8, "Tell me about the hub"), (9, "Show me all of the network"), (10, "What issues does the modem have"), (11, "Does the router require the hub and the line?"), (12, None), (13, "  "), (14, "Which router or hub?"),
        (15, "I want to cancel my contract"), (16, "The hub and the plan, please"),
    ]
    q = {r["i"]: r for r in builders.dispatched(described(spark, rows, voc, rel), "question", "qa", builders.prefixes([("qa", "https://example.org/")])).collect()}
    head = lambda i: q[i]["query"].split("#>\n")[-1]
    assert q[1]["intent"] == "SELECT_COMPATIBILITY" and "FILTER NOT EXISTS { ?router qa:isIncompatibleWith ?hub . }" in q[1]["query"] and "SELECT DISTINCT ?router ?hub ?compatibilityStatus ?restriction" in q[1]["query"]
    assert q[2]["intent"] == "SELECT_TROUBLESHOOT" and 'FILTER(STR(?si) = "light:blinking_red")' in q[2]["query"] and "?issue qa:hasCause ?cause ." in q[2]["query"] and q[2]["query"].rstrip().endswith("ORDER BY ?priority ?issue")
    assert q[3]["intent"] == "SELECT_REQUIREMENTS" and 'FILTER(?isMandatory = "true"^^xsd:boolean)' in q[3]["query"]
    assert q[4]["intent"] == "SELECT_ACCOUNT" and "?contract qa:hasContractEndDate ?date ." in q[4]["query"]
    assert q[5]["intent"] == "ASK_BOOLEAN" and "ASK {" in q[5]["query"]
    assert q[6]["intent"] == "SELECT_CONFIGURE" and "qa:hasConfigurationStep ?steps" in q[6]["query"]
    assert q[7]["intent"] == "ASK_EXISTS" and "?line rdf:type qa:Line ." in q[7]["query"] and "SELECT" not in head(7).split("OPTIONAL")[0]
    assert q[8]["intent"] == "DESCRIBE_ENTITY" and "DESCRIBE qa:Hub" in q[8]["query"]
    assert q[9]["intent"] == "CONSTRUCT_GRAPH" and "CONSTRUCT {" in q[9]["query"] and q[10]["intent"] == "SELECT_ISSUES" and "qa:hasKnownIssue" in q[10]["query"]
    assert q[11]["nary_kind"] == "PRECONDITION_CHAIN" and "# n-ary PRECONDITION_CHAIN" in q[11]["query"] and "?router qa:requires ?line ." in q[11]["query"]
    assert q[12]["query"] is None and q[13]["query"] is None
    assert "UNION" in q[14]["query"] and q[14]["classes"] == ["owl:unionOf(qa:Router)", "owl:unionOf(qa:Hub)"]
    assert "?terminationFee" in q[15]["query"] and q[16]["intent"] == "SELECT_GENERAL" and "?hub qa:associatedWith ?plan ." in q[16]["query"]
    run = builders.batch(spark.createDataFrame([("a", "x", "q1"), ("nan", "x", "q2"), (None, "x", "q3"), (" ", "x", "q4"), ("b", "x", None)], "question string, intent string, query string"), "question").collect()
    assert [(r["question"], r["intent"]) for r in run] == [("a", "x"), ("b", "ERROR")]


def test_properties_relations_and_context(spark):
    df = spark.createDataFrame([(1, "The fee: 12.5% is not paid within 30 days, see section 4A(b)"), (2, None), (3, ""), (4, "Under [2019] NSWSC 12 in Queensland?"), (5, "Under [2019] NSWSC 12"), (6, "A Commonwealth rule")], "i int, question string").withColumn("t", transform.folded(F.col("question")))
    df = transform.metadata(df, "question", R.METADATA)
    got = {r["i"]: r for r in df.select("i", "sections", "days", transform.data_properties(F.col("t"), {"fee": "hasFee", "within": "hasPeriod"}, {"hasDays": F.col("days")}).alias("p"), transform.surface_relations(F.col("t"), {"paid": "pays"}).alias("r"), transform.jurisdiction(F.col("question"), F.col("t"), R.PLACES, R.COURTS, R.JURISDICTION_WORDS, "federal").alias("j")).collect()}
    assert {(x["name"], x["value"]) for x in got[1]["p"]} == {("hasFee", "12.5%"), ("hasPeriod", "30"), ("hasDays", "30")} and got[1]["sections"] == ["4A(b)"]
    assert [(x["name"], x["negated"]) for x in got[1]["r"]] == [("pays", True)]
    assert got[2]["p"] in (None, []) and got[2]["j"] is None and got[3]["p"] == []
    assert (got[4]["j"], got[5]["j"], got[6]["j"], got[1]["j"]) == ("nsw", "nsw", "commonwealth", "federal")  # a place counts wherever its name stands


def sentence(*rows):
    return [{"text": t, "lemma": m, "pos": p, "tag": "X", "dep": d, "head": h} for t, m, p, d, h in rows]


BANKS = sentence(("The", "the", "DET", "det", 2), ("central", "central", "ADJ", "amod", 2), ("bank", "bank", "NOUN", "nsubj", 5), ("does", "do", "AUX", "aux", 5), ("not", "not", "PART", "neg", 5), ("hold", "hold", "VERB", "ROOT", 5), ("three", "three", "NUM", "nummod", 8), ("written", "write", "VERB", "amod", 8), ("loans", "loan", "NOUN", "dobj", 5), ("or", "or", "CCONJ", "cc", 8), ("bonds", "bond", "NOUN", "conj", 8))


def test_tree_passes(spark):
    voc = triples.Vocabulary({"bank": "Bank", "loans": "Loan", "bonds": "Bond"})
    tree = parsed.Tree(BANKS)
    assert list(parsed.verb_pass(tree, voc, {"hold": "holds"})) == [("Bank", "doesNotHolds", "Loan", 0.95, "verb", True)]
    assert list(parsed.attribute_pass(tree, voc, {"written": "hasForm"}, frozenset({"written"}))) == [("Loan", "hasForm", '"written"', 0.807, "attribute", False)]
    assert list(parsed.logical_pass(tree, voc)) == [("Loan", "owl:unionOf", "Bond", 0.95, "logical", False)]
    assert list(parsed.general_pass(tree)) == [("ent:bank", "rel:neg_hold", "ent:loan", 0.70, "general", True)]
    assert parsed.relations(BANKS, [("bank", "Bank"), ("loans", "Loan")], {"hold": "holds"}) == [("?bank", "holds", "?loan", True)]
    df = spark.createDataFrame([("a", BANKS, [{"label": "ORG", "surface": "bank"}, {"label": "ODD", "surface": "x"}]), ("a", None, None), ("b", [], [])], f"g string, tokens {parsed.TOKENS}, ents {parsed.ENTS}")
    f = parsed.syntax_features(df).collect()
    assert f[0]["dep_tree_depth"] == 2 and f[0]["ne_ORG"] == 1 and f[0]["ne_count"] == 2 and f[0]["pos_NOUN"] == 27.27 and f[1]["dep_tree_depth"] == 0 and f[1]["ne_density"] == 0.0
    assert {r["g"]: r["n"] for r in parsed.syntax_profiles(parsed.syntax_features(df), "g").collect()} == {"a": 2, "b": 1}
    assert parsed.tree_triples(df, ["g"], {"bank": "Bank", "loans": "Loan"}, {"hold": "holds"}, {}, ("three",)).count() == 2
    both = parsed.tree_triples(df.withColumn("t", F.lit("The bank is regulated by the board. The bank holds.")), ["g"], {"bank": "Bank", "loans": "Loan", "board": "Board"}, {"hold": "holds"}, {}, ("three",), text="t").filter("g = 'a'").collect()
    assert [r["step"] for r in both if r["predicate"] == "regulatedBy"] == ["structural"] * 2 and [r["confidence"] for r in both] == sorted((r["confidence"] for r in both), reverse=True) or len(both) == 4
    n = df.select(transform.ner_map(F.col("ents"), R.ENTITY_LABELS).alias("n")).first()["n"]
    assert [(x["label"], x["class"], x["data_prop"]) for x in n] == [("ORG", "Organisation", None)]


def test_terms_and_filters(spark):
    t = spark.createDataFrame([("a", '"x \\"y\\""@en'), ("b", '"5"^^xsd:integer'), ("c", "<https://e.org/1>"), ("d", "ex:1"), ("e", '"z"')], "s string, o string")
    got = {r["s"]: tuple(r)[1:] for r in t.select("s", algebra.string(F.col("o")), algebra.lang(F.col("o")), algebra.datatype(F.col("o")), algebra.expanded(F.col("o"), {"ex": "https://e.org/"})).collect()}
    assert got["a"][:3] == ('x "y"', "en", "xsd:string") and got["b"][:3] == ("5", "", "xsd:integer") and got["c"][:3] == ("https://e.org/1", "", None) and got["d"][3] == "<https://e.org/1>" and got["e"][:3] == ("z", "", "xsd:string")
    assert algebra.minus(t.select("s"), t.select("o")).count() == 5 and algebra.minus(t, t.filter("s = 'a'").select("s")).count() == 4
    assert t.select(algebra.blank(F.col("s"))).distinct().count() == 5


def test_percentiles_and_tails(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 1.5, float("nan"), None])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = {"p0": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p1": 1.0}
    got = {r["g"]: r for r in stats.percentiles(df, ["g"], ["x"], qs).collect()}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert [got[g][f"x_{k}"] for k in qs] == pytest.approx([float(np.percentile(v, 100 * q)) for q in qs.values()])
    assert "none" not in got and stats.percentiles(df.limit(0), ["g"], ["x"], qs).count() == 0
    from lexisift.functions.stats import chi2_tail

    want = {(3.84, 1): 0.05, (5.99, 2): 0.05, (7.815, 3): 0.05, (18.307, 10): 0.05, (30.578, 15): 0.01, (0.0, 4): 1.0}
    d = spark.createDataFrame([(x, k, p) for (x, k), p in want.items()], "x double, k int, p double")
    assert all(r["got"] == pytest.approx(r["p"], abs=1e-3) for r in d.withColumn("got", chi2_tail(F.col("x"), F.col("k"))).collect())


def test_footers_and_limits(spark):
    cells = spark.createDataFrame([("sparql", "d", "m1", 60.0), ("nlq_cot", "d", "m1", 50.0), ("sparql_cot", "d", "m1", None), ("sparql", "d", "m2", 40.0)], "method string, domain string, model string, recall_win_rate double")
    r = pairing.rate_footer(cells).first()
    assert (r["sparql"], r["nlq_cot"], r["sparql_cot"], r["adv_1"], r["adv_2"]) == (50.0, 50.0, None, 10.0, None)
    s = spark.createDataFrame([("TelcoQA", -10.0, 5.0), ("zeta", None, None), ("LegalQA", 1.0, 2.0)], "domain string, lo double, hi double")
    assert {x["domain"]: x["high"] for x in latent.plot_limits(s).collect()} == {"TelcoQA": 15.2, "zeta": 30.0, "LegalQA": 5.44}
    assert [x["domain"] for x in s.orderBy(*latent.domain_order(F.col("domain"))).collect()] == ["TelcoQA", "LegalQA", "zeta"]


def test_counts_against_references(spark):
    r = spark.createDataFrame([(1, "q1", "nlq", "a b c d"), (1, "q1", "cot", "nan"), (2, "q2", "nlq", "e f"), (3, None, "nlq", None)], "id int, q string, m string, text string")
    t = spark.createDataFrame([(1, "nlq", 0.95), (1, "nlq", 0.7), (1, "cot", 0.9)], "id int, m string, confidence double")
    g = spark.createDataFrame([("q1",)] * 4, "q string")
    got = {(x["id"], x["m"]): x for x in triples.density_by_method(r, ["id"], "m", "text", t, g, "q").collect()}
    assert (got[1, "nlq"]["triple_count_c"], got[1, "nlq"]["ratio_c_over_g"], got[1, "nlq"]["kd"]) == (2, 0.5, 0.25)
    assert got[1, "cot"]["missing"] and got[1, "cot"]["triple_count_c"] == 0 and got[2, "nlq"]["ratio_c_over_g"] is None and len(got) == 4
    n = triples.numbered(spark.createDataFrame([(i, None if i % 3 else f" k{i} ") for i in range(50)], "i int, k string"), "k", ["i"], "out", buckets=7).orderBy("i").collect()
    assert [x["out"] for x in n] == [str(i + 1) if i % 3 else f"k{i}" for i in range(50)]


def test_sources_and_sinks(spark, tmp_path):
    assert tables.resolve_column(["S.No", "Natural Language Query"], "Natural Language") == "Natural Language Query"
    assert tables.resolve_column(["id", "Ground_Truth"], r"ground_?truth", "pattern") == "Ground_Truth"
    assert tables.resolve_column(["a"], "b") is None
    df = spark.createDataFrame([("  long enough  ",), ("no",), (None,)], "`SPARQL Query` string")
    assert [r["text"] for r in tables.corpus(df, "sparql query", 3).collect()] == ["long enough"]
    out = sinks.write_results(spark.createDataFrame([("ok",), ("ERROR: x",), (None,)], "r string"), str(tmp_path / "run"), "r").first()
    assert (out["total"], out["successful"], out["errors"]) == (3, 2, 1)
    assert r"a\_b & --" in sinks.latex_table(spark.createDataFrame([("a_b", None)], "x string, y string"))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "fiqa.json").write_text('{"metadata": {"analysis_type": "x"}, "results": [{"Query_ID": 1}, {"Query_ID": 2}]}')
    (tmp_path / "j" / "bad.json").write_text("not json")
    got = tables.result_files(spark, str(tmp_path / "j"), ["x"]).collect()
    assert [r["domain"] for r in got] == ["finance", "finance"]


def test_resumable_stream(spark, tmp_path):
    from lexisift.streaming import resume

    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    spark.createDataFrame([(1,), (2,)], "k int").coalesce(1).write.parquet(src)
    step = lambda df: df.withColumn("d", F.col("k") * 2)
    resume.process_new(spark, src, "k int", step, sink, ck)
    resume.process_new(spark, src, "k int", step, sink, ck)
    spark.createDataFrame([(3,)], "k int").coalesce(1).write.mode("append").parquet(src)
    resume.process_new(spark, src, "k int", step, sink, ck)
    assert sorted(r["d"] for r in spark.read.parquet(sink).collect()) == [2, 4, 6]


def test_keys_may_stand_in_any_order(spark):
    df = spark.createDataFrame([("A", "B", "The bond is regulated by the bank.", 1, 2.0)], "x string, y string, text string, o int, v double")
    for keys in (["x", "y"], ["y", "x"]):
        for got in (triples.extract(df, keys, "text", {"bond": "Bond", "bank": "Bank"}), triples.entity_spans(df, keys, "text", {"bond": "Bond"}), stats.bootstrap_ci(df, keys, "v", "o")):
            assert {(r["x"], r["y"]) for r in got.collect()} == {("A", "B")}
