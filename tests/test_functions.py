"""Coercion traps, path lookup, LCS ratio properties."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hygeia.functions import fuzzy as FZ
from hygeia.functions import paths as P
from hygeia.functions import text as T


def _texts(spark, value, infer=False):
    df = spark.createDataFrame([(json.dumps({"a": {"b": value}}),)], "doc string")
    df = P.add_path_texts(df, P.to_doc_variant(F.col("doc"), "json"), ["a.b"], prefix="_t", infer=infer)
    return df.first()["_t0"]


def test_falsy_and_text(spark):
    assert _texts(spark, 0) == ""
    assert _texts(spark, "0") == "0"
    assert _texts(spark, False) == ""
    assert _texts(spark, True) == "True"
    assert _texts(spark, 64.0) == "64.0"
    assert _texts(spark, []) == ""
    assert _texts(spark, {}) == ""
    assert _texts(spark, " x ") == "x"
    assert _texts(spark, None) == ""
    assert _texts(spark, 0, infer=True) == "0"
    assert _texts(spark, False, infer=True) == "False"
    assert _texts(spark, None, infer=True) is None


def test_literal_key_wins(spark):
    docs = [(json.dumps({"a.b": None, "a": {"b": "nested"}}),), (json.dumps({"a": {"b": "nested"}}),),
            (json.dumps({"a": [{"b": "x"}]}),)]
    df = spark.createDataFrame(docs, "doc string")
    out = P.add_path_texts(df, P.to_doc_variant(F.col("doc"), "json"), ["a.b"], prefix="_t")
    assert [r["_t0"] for r in out.collect()] == ["", "nested", ""]


def test_struct_docs_match_json(spark):
    df = spark.createDataFrame([(("7", True, 0),)], "doc struct<s:string,b:boolean,i:int>")
    out = P.add_path_texts(df, F.col("doc"), ["s", "b", "i", "missing.x"], prefix="_t").first()
    assert (out["_t0"], out["_t1"], out["_t2"], out["_t3"]) == ("7", "True", "", "")


def test_int_canonicalisation(spark):
    cases = {"007": "7", "+5": "5", "1_000": "1000", "-0": "0", "-007": "-7",
             "1234567890123456789012345": "1234567890123456789012345", "12a": "12a", "1__0": "1__0"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["n"] for r in df.select("s", T.normalize_value(F.col("s"), F.lit(True)).alias("n")).collect()}
    assert got == cases


def test_default_process_and_strip(spark):
    r = spark.createDataFrame([("  SPEC-CPU_x \t",)], "s string").select(
        T.py_strip(F.col("s")).alias("a"), T.default_process(F.col("s")).alias("b")).first()
    assert r["a"] == "SPEC-CPU_x"
    assert r["b"] == "spec cpu_x"


def _dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_lcs_length_guard(spark):
    rows = [("x" * n + "", "x" * n) for n in (61, 62, 63, 64, 65)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r["r"] for r in FZ.with_ratio(df, "a", "b", "r").collect()]
    assert got == [1.0] * 5


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abcde ", max_size=12), st.text("abcde ", max_size=12)), min_size=1, max_size=20))
def test_ratio_matches_dp(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in FZ.with_ratio(df, "a", "b", "r").collect():
        a, b = r["a"], r["b"]
        exp = 0.0 if not a or not b else round(2 * _dp_lcs(a, b) / (len(a) + len(b)), 4)
        assert r["r"] == exp


def test_lcs_long(spark):
    rnd = random.Random(7)
    rows = [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))))
            for _ in range(50)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", FZ.lcs(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["n"] == _dp_lcs(r["a"], r["b"])


def test_first_id(spark):
    from pyspark.sql import functions as F

    from hygeia.functions.paths import first_id
    rows = [('{"`_id`":"a","id":"b"}',), ('{"`_id`":"","id":7}',), ('{"_id":{"$oid":"c"}}',), ("{}",)]
    d = spark.createDataFrame(rows, "doc string").select(first_id(F.parse_json("doc"), ["`_id`", "id", "_id"]).alias("i"))
    assert [r["i"] for r in d.collect()] == ["a", "7", "c", None]


def test_parameter_values(spark):
    import pytest

    from hygeia.plans import reports as RP
    from tests import golden as G
    ml = spark.createDataFrame(G.masterlist_rows(), G.ML_SCHEMA)
    assert RP.parameter_values(ml, "cpuMODEL", [], []).count() > 0
    with pytest.raises(ValueError, match="unknown parameter"):
        RP.parameter_values(ml, "nothing", ["CPUModel"], ["CPUModel"])


def test_more_configurations_of_a_value_than_a_page(spark):
    from hygeia.plans import reports as RP
    rows = [(i, f"m{i}", "T", "Published", ("v", "p", {"k": str(i)})) for i in range(150)]
    ml = spark.createDataFrame(rows, "ordinal bigint, ml_id string, type string, status string, "
                                     "data struct<value:string,mapping:string,metadata:map<string,string>>")
    req = spark.createDataFrame([("T", "v")], "req_type string, req_value string")
    assert RP.metadata_values(ml, req).count() == 150
