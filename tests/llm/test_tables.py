"""Operators over tables: dirty rows, hot groups, empty tables, and results against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexisift.llm import digest, encoding, markup, pairs, repetition, sentences, terms, tokens, truncation
from lexisift.llm.common import is_empty


def test_empty_predicate(spark):
    yes = [None, "", " \n", "\u200b\u200b", "NaN", "n/a", "[EMPTY]", "-", "...", "**Answer**:", "ANSWER:", "## Answer", "ERROR: out of memory", "ERROR processing query: timeout after 120 s", "DEGENERATE_OUTPUT: repeated token 'the' ×9", "答案："]
    no = ["No.", "Yes.", "Errors were found in the file.", "Answer: yes", "Nana called.", "0", "Error rates fell in May.", "A: yes"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(yes + no)], "i int, x string")
    # a size of the value changes no verdict
    for n in (300, 5000):
        yes += ["-" * n, "Answer: " + "-" * n, " " * n + "nan", "ERROR: " + "x y " * n, " \u200b" * n]
        no += ["a" * n, "- " * n + "the rule holds for a year", "Answer: " + "yes " * n]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(yes + no)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(is_empty(F.col("x"))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_terms_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aa bb cc dd ee Ff ÉÉ x1".split()) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "rid int, body string, term string")
    got = {(r["rid"], r["term"]): r["score"] for r in terms.term_scores(df, "rid", "body").collect()}
    n = len(texts)
    tf = [Counter((t or "").lower().split()) for t in texts]
    dfreq = Counter(w for c in tf for w in c)
    want = {}
    for i, c in enumerate(tf):
        w = {k: (0.1 + math.log(v)) * math.log((1 + n) / (1 + dfreq[k])) for k, v in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, k): x / norm if norm else 0.0 for k, x in w.items()}
    assert got == pytest.approx(want)
    assert terms.leading_terms(df.limit(0), "rid", "body").count() == 0


def test_leading_term_comes_back(spark):
    rows = [(i, f"every account is like the account of account {i}. what is zork{i % 50}? where is ZORK{i % 50}? unlike blip{i}.") for i in range(300)]
    df = spark.createDataFrame(rows, "rid int, body string")
    assert all(r["term"] == f"zork{r['rid'] % 50}" for r in terms.leading_terms(df, "rid", "body").collect())


def features_table(spark, rows):
    return spark.createDataFrame(rows, "feature_id long, release_tag string, run_date timestamp, ingested_at timestamp, domain string, complexity_score double, compositional_score double, char_count long")


def test_digest_bounds_hold(spark):
    import datetime as dt

    rng = random.Random(8)
    t0 = dt.datetime(2031, 1, 1)
    rows, truth = [], []
    for i in range(4000):
        v = rng.choice([rng.gauss(5, 2), 3.0, float("nan"), float("inf"), None])
        rows.append((i, "r", t0 + dt.timedelta(days=i % 5), t0, " A " if i % 3 else "a", v, None, None))
        if v is not None and math.isfinite(v):
            truth.append(v)
    df = features_table(spark, rows).repartition(6)
    keys = ["release_tag", "dkey", "metric"]
    merged = digest.merge_digests(digest.daily_digests(df), keys)
    assert merged.agg(F.sum("n")).first()[0] == len(truth)
    truth.sort()
    for r in digest.quantiles_from(merged, keys).collect():
        below, upto = sum(x < r["estimate"] for x in truth) / len(truth), sum(x <= r["estimate"] for x in truth) / len(truth)
        off = max(0.0, below - r["q"], r["q"] - upto)
        assert off <= r["rank_error"] + 1e-9 <= 0.6
    figs = spark.createDataFrame([("r", "a", "complexity_score", x) for x in (-1.0, 3.0, 4.2, 99.0)], "release_tag string, dkey string, metric string, x double")
    for r in digest.rank_bounds(merged, figs, keys, "x").collect():
        assert r["below_least"] <= sum(t < r["x"] for t in truth) <= r["below_most"]
        assert r["upto_least"] <= sum(t <= r["x"] for t in truth) <= r["upto_most"]


def test_wrong_figures(spark):
    import datetime as dt

    t0 = dt.datetime(2031, 1, 1)
    rows = [(i, "r", t0 + dt.timedelta(days=i % 3), t0, "A", float(i), 1.0, i) for i in range(101)]
    rows.append((0, "r", t0, t0 - dt.timedelta(days=1), "A", 1e9, 1.0, 5))  # outdated
    f = features_table(spark, rows)
    s = spark.createDataFrame(
        [("r", "complexity_score", "A", 25.0, 50.0, 75.0), ("r", "char_count", " a", 25.0, 60.0, 75.0), ("r", "compositional_score", "A", 1.0, 1.0, 1.0), ("x", "char_count", "A", 1.0, 1.0, 1.0), ("r", "char_count", "A", None, 50.0, 75.0)],
        "release_tag string, metric string, domain string, p25 double, median double, p75 double",
    )
    got = {tuple(r) for r in digest.wrong_figures(f, s).collect()}
    assert got == {("r", "char_count", " a"), ("r", "char_count", "A")}
    assert digest.wrong_figures(f.limit(0), s).count() == 0 and digest.wrong_figures(f, s.limit(0)).count() == 0


def test_days_are_kept(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2031, 1, 1)
    rows = [(i, "r", t0 + dt.timedelta(days=i % 3), t0, "A", float(i), 1.0, i) for i in range(90)]
    keys = ["release_tag", "dkey", "metric"]
    day = digest.keep_days(features_table(spark, [r for r in rows if r[2] == t0]), f"{tmp_path}/days")
    assert day.agg(F.sum("n")).first()[0] == 90 and day.select("day").distinct().count() == 1
    daily = digest.keep_days(features_table(spark, rows), f"{tmp_path}/days")
    assert daily.select("day").distinct().count() == 3 and daily.agg(F.sum("n")).first()[0] == 270
    again = digest.keep_days(features_table(spark, rows), f"{tmp_path}/days")
    assert again.agg(F.sum("n")).first()[0] == 270
    s = spark.createDataFrame([("r", "complexity_score", "A", 22.0, 44.0, 67.0), ("r", "char_count", "A", 22.0, 60.0, 67.0)], "release_tag string, metric string, domain string, p25 double, median double, p75 double")
    assert [tuple(r) for r in digest.wrong_figures(features_table(spark, rows), s, daily).collect()] == [("r", "char_count", "A")]
    assert digest.merge_digests(daily, keys).agg(F.sum("n")).first()[0] == 270


def test_containers(spark):
    rng = random.Random(2)
    sizes = [0, None, 2048, 2049, 4096, 10_000] + [rng.randint(1, 300) for _ in range(500)] + [77] * 400  # a hot length
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int")
    out = tokens.containers(df, 2048).collect()
    load, per = Counter(), Counter()
    for r in out:
        load[r["container"]] += r["n_tokens"]
        per[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= 2048
    assert max(load.values()) <= 2048 and {i: n or 0 for i, n in enumerate(sizes)} == {i: per[i] for i in range(len(sizes))}
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out)
    pieces = Counter(r["doc_id"] for r in out)
    assert all(pieces[i] == 1 for i, n in enumerate(sizes) if (n or 0) <= 2048) and pieces[3] == 2 and pieces[4] == 2 and pieces[5] == 5
    assert len(load) <= sum(n or 0 for n in sizes) / 2048 + 2
    assert tokens.containers(df.limit(0), 2048).count() == 0


def test_ranked_is_dense(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 else i % 5) for i in range(500)], "id long, length int")
    got = tokens.ranked(df, "length", "id", per_bucket=50).collect()
    by = {}
    for r in got:
        by.setdefault(r["length"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 500


def test_token_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (4, "x" * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == [15496, 995] and len(got[4]) > 100
    counts = {r["doc_id"]: r["n"] for r in tokens.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def values_table(spark, items):
    return spark.createDataFrame([(i, "nlq_response", "m1" if i % 2 else "m2", "q?", v) for i, v in enumerate(items)], "resp_id long, field string, model string, question string, value string")


def test_repetition_hosts(spark):
    items = ["The rate is due in May this year. " * 5, "Nothing to repeat here at all.", None, "", "-"] * 4
    got = repetition.repetition(values_table(spark, items)).collect()
    assert len(got) == 8 and all(r["failed"] == (r["share"] >= 0.5) for r in got) and {r["host_verdict"] for r in got} <= {"bad", "usual"}
    assert all(0 <= r["host_rate"] <= 1 for r in got)
    assert repetition.repetition(values_table(spark, ["x"]).limit(0)).count() == 0


def test_sentences_table(spark):
    got = sentences.sentences(values_table(spark, ["One. Two.", None, "n/a", ""]), ["resp_id", "field"]).collect()
    assert sorted((r["resp_id"], r["sent_start"], r["sent_end"]) for r in got) == [(0, 1, 4), (0, 6, 9)]


def test_broken_off(spark):
    base = ["The tenant must pay the rent before the end of the month.", "The clerk may keep the deposit for a short time."] * 10
    items = [*base, "The tenant must pay the rent before the end of the month", "The tenant must pay the rent before the", "The clerk may keep the depo", "Yes.", "Yes"]
    v = values_table(spark, items)
    got = {r["resp_id"]: r["truncated"] for r in truncation.broken_off(v, ["resp_id", "field"], ["model", "field"]).collect()}
    n = len(base)
    assert not any(got[i] for i in range(n + 1)) and got[n + 1] and got[n + 2] and not got[n + 3] and len(got) == len(items)
    assert truncation.broken_off(v.limit(0), ["resp_id", "field"], ["model", "field"]).count() == 0


def test_extract_votes_out_boilerplate(spark):
    page = '<div class="menu 1"><a href="x">Home</a> <a href="y">Help</a></div><div class="text">The rule holds for {} days.</div>'
    v = values_table(spark, [page.format(i) for i in range(10)] + ["no markup", None])
    got = markup.extract(v, ["resp_id", "field"]).collect()
    assert len(got) == 10 and all("Home" not in r["clean_text"] and "The rule holds" in r["clean_text"] and r["kinds"] == ["html"] for r in got)


def test_kinds_come_from_winning_paths(spark):
    rows = ["# Title\n\nThe rule holds.", "see [[Help:X|x]] and == T ==", "**bold** move", "a &amp; b", "plain text", None, "n/a", '<nav class="m 1"><a href="x">Home</a></nav>', "$$x^2$$ is it"]
    v = values_table(spark, rows)
    got = {r["resp_id"]: r["kinds"] for r in markup.kinds_found(v, ["resp_id", "field"]).collect()}
    assert got == {0: ["markdown"], 1: ["wiki"], 2: ["markdown"], 3: ["html"], 7: ["html"], 8: ["latex"]}
    p = spark.createDataFrame([(i, "h", [("markdown/strong", -1.0 if i < 3 else 5.0), ("html/div", 9.0)]) for i in range(4)] + [(9, "g", [("markdown/strong", 4.0)])], "k int, _host string, paths array<struct<path:string,score:double>>")
    assert {(r["host"], r["path"]): r["wins"] for r in markup.path_votes(p).collect()} == {("h", "markdown/strong"): False, ("h", "html/div"): True, ("g", "markdown/strong"): True}
    assert {r["k"]: r["kinds"] for r in markup.verdicts(p, ["k"]).collect()} == {0: ["html"], 1: ["html"], 2: ["html"], 3: ["html"], 9: ["markdown"]}
    clean = {r["resp_id"]: r["clean_text"] for r in markup.extract(v, ["resp_id", "field"]).collect()}
    assert clean[7] == "" and clean[2] == "bold move" and set(clean) == set(got)


def test_defects_table(spark):
    v = values_table(spark, ["Yes.", None, "ERROR: x", "I cannot help with this request."]).withColumn("question", F.when(F.col("resp_id") == 0, " ").otherwise("When does it end?"))
    cut = v.select("resp_id", "field", F.lit(True).alias("truncated")).limit(0)
    got = {r["resp_id"]: r["defect"] for r in pairs.defects(v, cut, ["resp_id", "field"]).collect()}
    assert got == {1: "empty", 2: "empty", 3: "refusal"}


def test_cut_pairs_keep_one_row(spark):
    v = values_table(spark, ["The warranty ends after two ye", "I cannot help with this request.", "It ends in May after two full years."]).withColumn("question", F.lit("When does it end?"))
    cut = v.filter("resp_id < 2").select("resp_id", "field", F.lit(True).alias("truncated"))
    got = {r["resp_id"]: r["defect"] for r in pairs.defects(v, cut, ["resp_id", "field"]).collect()}
    assert got == {0: "truncated", 1: "refusal", 2: None}


def test_continuations_leave_out_only_what_is_not_wanted(spark):
    texts = ["The bank may keep the fee. The bank must pay", "银行应将客户文件保存很多年。银行应当付款", "the fee the bank", None, ""] * 3
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    wanted = spark.createDataFrame([(k,) for t in ("The bank must pay", "应当付款", "the bank") for k in truncation.tails(t)], "key long")
    whole = {r["key"]: tuple(r)[1:] for r in truncation.continuations(df).collect()}
    some = {r["key"]: tuple(r)[1:] for r in truncation.continuations(df, only=truncation.key_filter(wanted)).collect()}
    keys = {r["key"] for r in wanted.collect()}
    assert keys <= set(some) and len(some) < len(whole) and all(whole[k] == x for k, x in some.items())


def test_repaired_table(spark):
    df = spark.createDataFrame([(1, "caf\u00c3\u00a9 open"), (2, None), (3, ""), (4, "café"), (1, "caf\u00c3\u00a9 open")], "doc_id long, text string").withColumn("restored", F.lit("clash"))
    got = encoding.repaired(df).collect()
    assert [(r["doc_id"], r["restored"]) for r in got] == [(1, "café open")] * 2


def test_queries_on_dirty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and empty tables run through the registered queries."""
    import datetime as dt

    from lexisift.llm.queries import QUERIES

    at = dt.datetime(2031, 3, 1)
    tables = {
        "all_models_responses": ("resp_id long, model string, domain string, query_id long, question string, sparql_query string, nlq_response string, nlq_cot_response string, sparql_response string, sparql_cot_response string, parsed_at timestamp, field string", [(1, None, None, None, None, None, "Yes.", None, "", "<b>x</b>", None, "clash"), (2, "m", "d", 1, "Why?", None, "I cannot answer this question.", "nan", "no end in", "Why?", at, None)]),
        "raw_qa": ("qa_id long, query_id string, domain string, institute string, document string, query_type string, question string, ground_truth string, loaded_at timestamp", [(1, None, None, None, None, None, None, None, None), (2, "2", "d", "i", "x", "t", "Why?", "Because. It is.", at)]),
        "inference_metrics": ("resp_id long, query_id long, model string, query_mode string, input_length int, generated_length int, generation_time_seconds double, confidence_score double, processing_timestamp timestamp", [(None, None, None, None, None, None, None, None, None), (2, 1, "m", "SPARQL", 5, 9, 1.0, float("nan"), at)] * 2),
        "model_config": ("name string, generation_max_new_tokens int", [("m", 9), (None, None)]),
        "paired_examples": ("example_id long, domain string, nlq string", [(1, None, None), (2, "d", "nan"), (3, "d", "[Auto-inferred] x"), (4, "d", "blue sky, BLUE sea"), (5, "d", "???")]),
        "sparql_features": ("feature_id long, release_tag string, run_date timestamp, ingested_at timestamp, domain string, doc_ref string, query_form string, complexity_level string, complexity_score double, compositional_score double, char_count long", [(None, None, None, None, None, None, None, None, None, None, None), (1, "r", at, at, " A", "x", "s", "l", float("inf"), 2.0, 3)] * 2),
        "scalar_summary": ("release_tag string, metric string, domain string, n long, mean double, median double, std double, min double, max double, p25 double, p75 double", [("r", "char_count", "a", 1, 3.0, 3.0, None, 3.0, 3.0, 3.0, 9.0), (None,) * 11]),
        "documents": ("doc_id long, text string, lang string", [(1, None, None), (2, "", "en"), (3, "caf\u00c3\u00a9", "fr"), (3, "caf\u00c3\u00a9", "fr")]),
    }
    for kind in ("full", "none"):
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows if kind == "full" else [], schema).write.parquet(f"{tmp_path}/{kind}/{name}.parquet")
    got = {name: f(spark, f"{tmp_path}/full").collect() for name, f in QUERIES.items()}
    assert [tuple(r) for r in got["p1_found"]] == [(4, "blue")]
    assert {tuple(r) for r in got["p7_found"]} >= {("nlq_response", 2, "refusal"), ("nlq_cot_response", 2, "empty"), ("sparql_cot_response", 2, "copy")}
    assert [tuple(r) for r in got["p6_found"]] == [(1, "sparql_cot_response", "html")]
    assert ("sparql_response", 2) in {(r["field"], r["resp_id"]) for r in got["p4_found"]}
    assert [tuple(r) for r in got["p5_found"]] == [("r", "char_count", "a")]
    assert sorted(r["doc_id"] for r in got["p10_found"]) == [3, 3] and len(got["p9_containers"]) == 4
    assert all(len(f(spark, f"{tmp_path}/none").collect()) == 0 for f in QUERIES.values())


def test_keys_may_stand_in_any_order(spark):
    src = values_table(spark, ["One rule <b>holds</b>. One rule holds. One rule holds. It holds fo", "I cannot answer this question."])
    want = {(i, "nlq_response", "m2" if i == 0 else "m1") for i in (0, 1)}
    for keys in (["resp_id", "field", "model"], ["model", "field", "resp_id"], ["field", "model", "resp_id"]):
        cut = src.select(*keys, F.lit(True).alias("truncated")).limit(0)
        made = [
            repetition.shares(src, keys), sentences.sentences(src, keys), truncation.look(src, keys), truncation.broken_off(src, keys, ["model", "field"]), pairs.defects(src, cut, keys),
            markup.extract(src.withColumn("host", F.lit("h")), keys, host="host"),
        ]
        for got in made:
            assert {(r["resp_id"], r["field"], r["model"]) for r in got.collect()} <= want
    got = repetition.repetition(src).collect()
    assert {(r["resp_id"], r["field"], r["model"]) for r in got} == want
