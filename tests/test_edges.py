"""Sources, sinks, provider paths and harness pieces."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexisift import session
from lexisift.functions import providers, questions, values, vectors
from lexisift.operators import harness, pairing
from lexisift.sources import sinks, tables


def test_workbooks_come_back(spark, tmp_path):
    a = spark.createDataFrame([(1, "x & <y>", 0.25, None), (2, "ünï \u0001 z", 0.75, "b")], "id int, name string, score double, gap string")
    path = f"{tmp_path}/out.xlsx"
    sinks.write_workbook({"one": a, "two": a.select("id"), "none": a.limit(0)}, path, graded={"score": (0.3, 0.6)})
    back = tables.workbook(spark, path)
    assert list(back) == ["one", "two", "none"] and back["none"].count() == 0
    assert [tuple(r) for r in back["one"].collect()] == [("1", "x & <y>", "0.25", None), ("2", "ünï  z", "0.75", "b")]
    assert [r["gap"] for r in tables.query_table(spark, path).collect()] == ["", "b"]
    with pytest.raises(ValueError):
        sinks.write_workbook({"x": a}, path, most=1)
    assert tables.without(["GPT", " Ground_Truth ", "x"]) == ["GPT", "x"]


def test_csv_with_mark_and_buffers(spark, tmp_path):
    df = spark.createDataFrame([("q1", 'say "hi", ok'), ("q2", None)], "question string, answer string")
    sinks.write_csv(df, f"{tmp_path}/r.csv", bom=True)
    part = next(f for f in os.listdir(f"{tmp_path}/r.csv") if f.endswith(".csv"))
    assert open(f"{tmp_path}/r.csv/{part}", "rb").read(3) == b"\xef\xbb\xbf"
    assert sorted(tuple(r) for r in tables.query_table(spark, f"{tmp_path}/r.csv").collect()) == [("q1", 'say "hi", ok'), ("q2", "")]
    for _ in range(2):
        sinks.append_buffer(df, f"{tmp_path}/buffer")
    assert sinks.read_buffer(spark, f"{tmp_path}/buffer").count() == 4
    assert sinks.narrative(df, "{question}: {answer}") == 'q1: say "hi", ok\nq2: n/a'


def test_files_by_convention(spark, tmp_path):
    os.makedirs(f"{tmp_path}/m_NLQ")
    json.dump({"metadata": {"x": 1}, "results": [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]}, open(f"{tmp_path}/m_NLQ/m_NLQ.json", "w"))
    got = tables.convention_files(spark, str(tmp_path), ["m", "other"], ["_NLQ", "_SPARQL"])
    assert sorted((r["id"], r["model"], r["mode"]) for r in got.collect()) == [(1, "m", "nlq"), (2, "m", "nlq")]
    assert tables.convention_files(spark, str(tmp_path), ["none"], ["_NLQ"]).count() == 0


def test_normal_forms(spark):
    texts = [None, "", " \n", "ﬁne print", "a\x0bb\x07c", "ＡＢＣ  x\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(questions.normalised(F.col("t"))).collect()] == ["[EMPTY]", "[EMPTY]", "[EMPTY]", "fine print", "a bc", "ABC  x"]
    s = spark.createDataFrame([("One. Two! Three? ",), ("",), (None,)], "t string").select(questions.sentence_split(F.col("t"))).collect()
    assert s[0][0] == ["One.", "Two!", "Three?"] and s[1][0] == []


def test_claim_and_token_recall(spark):
    lab = lambda e, n: [("ENTAILMENT", e), ("neutral", n)]
    rows = [(1, lab(0.9, 0.1), "ref"), (1, lab(0.2, 0.8), "ref"), (2, lab(0.9, 0.1), "[EMPTY]"), (3, None, "ref"), (4, lab(0.5, 0.5), "ref")]
    df = spark.createDataFrame(rows, "id int, labels array<struct<label:string,score:double>>, reference string")
    got = {r["id"]: (r["n_claims"], r["n_entailed"], r["claim_recall"]) for r in providers.claim_recall(df, ["id"]).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 1, None), 3: (1, 0, 0.0), 4: (1, 1, 1.0)}
    v = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]]), ([], [[1.0]])], "r array<array<double>>, c array<array<double>>")
    assert [x[0] for x in v.select(vectors.alignment_recall(F.col("r"), F.col("c"))).collect()] == [pytest.approx(0.5), None]


def test_names_texts_and_ids(spark):
    df = spark.createDataFrame([("FiQA_llama-3 chat",), ("telcoqa",), ("Other",), (None,)], "n string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(values.domain_of_name(F.col("n"))).collect()] == [("FiQA", "Llama-3 Chat"), ("TelcoQA", ""), ("Other", None), (None, None)]
    ids = spark.createDataFrame([("10",), ("9",), ("b",), ("a",), ("1.5",)], "i string")
    assert [r["i"] for r in ids.orderBy(*values.id_order("i")).collect()] == ["1.5", "9", "10", "a", "b"]
    assert [r["i"] for r in harness.head(ids, values.id_order("i"), 2).collect()] == ["1.5", "9"]
    e = spark.createDataFrame([(" Rule_Based",), ("general",), (None,)], "x string")
    assert e.filter(values.of_extractor("x")).count() == 1


def test_guards_and_loaders(spark):
    df = spark.createDataFrame([("q", "r"), (" ", "r"), (None, None)], "s string, response string")
    assert [r["response"] for r in harness.guarded(df, F.col("s"), F.lit("nlq"), "response").collect()] == ["r", "ERROR: empty source for mode nlq", "ERROR: empty source for mode nlq"]

    def bad():
        raise RuntimeError("no memory")

    assert harness.first_loaded([bad, lambda: "eight bits"]) == "eight bits"
    with pytest.raises(RuntimeError, match="no memory"):
        harness.first_loaded([bad, bad])
    assert len(harness.CHAT_TEMPLATES) == 8 and all("{prompt}" in t for t in harness.CHAT_TEMPLATES.values())


def test_baseline_counts_once(spark):
    df = spark.createDataFrame([("d", "m", "nlq", 1.0), ("d", "m", "nlq", 3.0), ("d", "n", "nlq", 5.0), ("d", "m", "sparql", 30.0)], "domain string, model string, method string, x double")
    got = {r["method"]: (r["n"], r["mid"], r["log_scale"]) for r in pairing.box_stats(df, "x", baseline_once=("model", "domain")).collect()}
    assert got == {"nlq": (2, 3.0, False), "sparql": (1, 30.0, False)}


def test_durable_tables_live_in_the_applications_folder(spark):
    t = session.durable(spark.range(3))
    assert t.count() == 3 and spark.sparkContext.applicationId in t.inputFiles()[0]
