import math

import pytest
from pyspark.sql import functions as F

from lexisift.functions import formal, questions, stats, values, vectors


def col(spark, items, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_query_key(spark):
    got = col(spark, ["7", "7.0", "000007", " 263 ", "1234567", "-3", "abc", None, "", "inf"], values.query_key)
    assert got == ["000007", "000007", "000007", "000263", "1234567", "-00003", "abc", None, "", "inf"]


def test_method_name(spark):
    assert col(spark, ["NLQ", "sparql cot", "SPARQL+CoT", "NLQ-CoT", "nlq_chain", "other", None], values.method_name) == ["nlq", "sparql_cot", "sparql_cot", "nlq_cot", "nlq_cot", "other", None]


def test_finite_and_guarded(spark):
    xs = [1.5, float("nan"), float("inf"), None, -1e12]
    assert col(spark, xs, values.finite, "double") == [1.5, None, None, None, -1e12]
    assert col(spark, xs, values.guarded, "double") == [1.5, 0.5, 0.5, 0.5, -1e8]
    assert col(spark, [10.0, 0.0, -1.0, None], values.log10_safe, "double") == [1.0, None, None, None]


def test_missing_and_errors(spark):
    assert col(spark, ["x", "", " NaN ", "N/A", None], values.is_missing_text) == [False, True, True, True, True]
    assert col(spark, ["ERROR: x", "DEGENERATE_OUTPUT: y", "an ERROR", None], values.is_error) == [True, True, False, False]


QUERY = """PREFIX fi: <https://example.org/fi#>
SELECT DISTINCT ?result WHERE { # n-ary TEMPORAL_CONTEXT
  ?s fi:limit ?result .
  OPTIONAL { ?s fi:until ?u . FILTER (?u > 3) }
  FILTER NOT EXISTS { ?s fi:gone ?g . }
} ORDER BY ?result LIMIT 5"""


def test_formal_features(spark):
    df = spark.createDataFrame([(1, QUERY), (2, ""), (3, None), (4, "ask nothing } {")], "i int, q string")
    r = {x["i"]: x for x in formal.query_features(df, "q").collect()}
    a = r[1]
    assert (a["query_form"], a["op_FILTER"], a["op_FILTER_NOT_EXISTS"], a["op_OPTIONAL"], a["nesting_depth"], a["nary_count"]) == ("SELECT", 1, 1, 1, 2, 1)
    assert a["complexity_score"] == 2 + 3 + 1.5 + 1 + 1 + 2 * 0.5  # the local name fi:limit counts as well
    assert a["join_count"] == 3 and a["has_negation"] == 1 and a["line_count"] == 6
    assert r[2]["query_form"] == "UNKNOWN" and r[2]["ttr"] == 0.0 and r[2]["nesting_depth"] == 0
    assert r[3]["query_form"] is None and r[3]["char_count"] is None
    assert r[4]["query_form"] == "ASK" and r[4]["nesting_depth"] == 0


def test_jaccard(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", ""), ("a", ""), ("A", "a")], "x string, y string")
    assert [round(r[0], 4) for r in df.select(formal.jaccard_tokens(F.col("x"), F.col("y"))).collect()] == [0.3333, 1.0, 0.0, 1.0]


def test_question_types(spark):
    qs = ["Who pays?", " how many days", "How is it", "would you", "List all", "élan", "", None]
    assert col(spark, qs, questions.question_type) == ["Who", "How_many", "How", "Can_Could", "List", "Other", "Other", None]


def test_clean_response(spark):
    xs = ["Think. ANSWER: no. **Answer**: - yes\n", "plain", "**Answer**:", "answer : (a)", None, "* élan"]
    assert col(spark, xs, questions.clean_response) == ["yes", "plain", "", "(a)", None, "élan"]


def test_claims_and_degenerate(spark):
    assert col(spark, ["One two three four five. Too short. Six words are in this one!"], questions.claims)[0] == ["One two three four five.", "Six words are in this one!"]
    line = "\n".join(["same line"] * 11)
    assert col(spark, [line, "\n".join(["same"] * 10), "no " * 11, "no " * 10, None], questions.degenerate) == ["line", None, "word", None, None]


def test_mattr(spark):
    toks = [["a", "b", "a", "c"], [], ["a"] * 60]
    df = spark.createDataFrame([(t,) for t in toks], "t array<string>")
    got = [r[0] for r in df.select(questions.mattr(F.col("t"), 50)).collect()]
    assert got == pytest.approx([0.75, 0.0, 0.02])


def test_tails(spark):
    zs = [0.0, 0.5, 1.96, -3.0]
    for z, p in zip(zs, col(spark, zs, stats.normal_tail, "double")):
        assert p == pytest.approx(0.5 * math.erfc(abs(z) / math.sqrt(2)), abs=1e-7)
    df = spark.createDataFrame([(3.84146, 1, 0.05), (5.99146, 2, 0.05), (7.81473, 3, 0.05), (9.48773, 4, 0.05), (18.307, 10, 0.05), (11.0705, 5, 0.05)], "x double, k int, p double")
    for got, want in df.select(stats.chi2_tail(F.col("x"), F.col("k")), "p").collect():
        assert got == pytest.approx(want, abs=1e-5)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(vectors.angle(F.col("a"), F.col("b"))).collect()] == [90.0, 0.0, 90.0]


def test_mask_padding(spark):
    df = spark.createDataFrame([([-1.0, 0.0, float("nan"), -20.0, 3.0, None],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(values.mask_padding(F.col("a"))).collect()] == [[-1.0, -8.0, 0.0], []]
