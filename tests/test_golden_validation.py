"""Validation of the hand-derived golden dataset (every branch of V4-V9)."""

import pytest
from pyspark.sql import functions as F

from hygeia.functions.paths import to_doc_variant
from hygeia.plans import reports as RP
from hygeia.plans import rules as R
from hygeia.plans import suggest as SG
from hygeia.plans import validate as V
from tests import golden as G


@pytest.fixture(scope="module")
def golden(spark):
    ml = spark.createDataFrame(G.masterlist_rows(), G.ML_SCHEMA)
    ex = spark.createDataFrame(G.execution_rows(), "exec_id string, doc string")
    ex = ex.withColumn("doc", to_doc_variant(F.col("doc"), "json"))
    proc = spark.createDataFrame(G.PROC_ROWS, "cpuModelNo string, family string, ordinal bigint")
    rules = R.build_rules(ml, ex, F.col("doc"), proc)
    val = V.validate(rules, ex, F.col("doc")).cache()
    return rules, ex, val


def test_field_types(golden):
    rules, _, _ = golden
    assert rules.types["coreCount"] == "INTEGER"
    assert all(t == "STRING" for f, t in rules.types.items() if f != "coreCount")
    m = {x.field: x for x in rules.mappings}
    assert m["BenchmarkType"].path == "" and m["BenchmarkType"].resolved == "benchmarkType"
    assert {x.field for x in rules.mappings if x.primary} == {"CPUModel", "instanceType", "Benchmark"}


def test_verdicts_and_names(golden):
    _, _, val = golden
    got = {r["exec_id"]: (r["isValid"], list(r["invalid_names"])) for r in val.collect()}
    assert got == {
        "e1": (True, []),
        "e2": (False, ["coreCount"]),
        "e3": (False, ["CPUModel", "Family", "coreCount"]),
        "e4": (False, ["cloudProvider", "instanceType"]),
        "e5": (False, ["CPUModel"]),
        "e6": (False, ["Benchmark", "BenchmarkType"]),
    }


def test_payload_details(golden):
    _, _, val = golden
    rows = {r["exec_id"]: r for r in val.collect()}
    e2 = rows["e2"]["invalidPayload"][0]
    assert (e2["field"], e2["value"], e2["validation_status"]) == ("CPUModel", "7543", "valid")
    assert [(m["name"], m["value"], m["validation_status"]) for m in e2["metadata"]] == [
        ("Family", "Milan", "valid"), ("coreCount", "48", "invalid")]
    assert rows["e2"]["fieldStatus"]["CPUModel"] == "valid"
    e3 = rows["e3"]["invalidPayload"][0]
    assert [(m["name"], m["value"]) for m in e3["metadata"]] == [("Family", ""), ("coreCount", "32")]
    assert all(m["validation_status"] == "invalid" for m in e3["metadata"])
    e5 = rows["e5"]["invalidPayload"][0]
    assert e5["value"] == "" and list(e5["metadata"]) == []
    assert rows["e6"]["fieldStatus"]["CPUModel"] == "valid"  # 032 -> 32 matches m1


def test_counts(golden):
    rules, _, val = golden
    counts = {r["field"]: (r["valid"], r["invalid"]) for r in
              RP.validation_counts(val, [m.field for m in rules.mappings]).collect()}
    assert counts == {"CPUModel": (4, 2), "Family": (5, 1), "coreCount": (4, 2), "instanceType": (5, 1),
                      "cloudProvider": (5, 1), "Benchmark": (5, 1), "BenchmarkType": (5, 1)}
    t = V.totals(val).first()
    assert (t["valid"], t["invalid"], t["processed"]) == (1, 5, 6)


def test_record_suggestions(golden):
    rules, _, val = golden
    rec = SG.record_suggestions(rules, val).collect()
    by = {}
    for r in rec:
        by.setdefault((r["exec_id"], r["field"]), []).append((r["rank"], r["ml_id"], r["overall_score"]))
    assert sorted(by[("e2", "CPUModel")]) == [(1, "m1", 0.8482), (2, "m2", 0.8482), (3, "m3", 0.0146)]
    assert sorted(by[("e3", "CPUModel")]) == [(1, "m1", 0.6107), (2, "m2", 0.381), (3, "m3", 0.0202)]
    assert sorted(by[("e4", "instanceType")]) == [(1, "m4", 0.8528)]
    assert sorted(by[("e6", "Benchmark")]) == [(1, "m5", 1.0)]
    assert ("e5", "CPUModel") not in by


def test_suggestion_field_scores(golden):
    rules, _, val = golden
    items = SG.suggestion_items(SG.record_suggestions(rules, val)).collect()
    got = {(r["exec_id"], r["name"], r["rank"]): r["score"] for r in items}
    assert got[("e3", "CPUModel", 1)] == 0.6667
    assert got[("e3", "CPUModel", 3)] == 0.3077
    assert got[("e2", "coreCount", 2)] == 0.5
    assert got[("e2", "coreCount", 1)] == 0.0
    assert got[("e4", "instanceType", 1)] == 0.8889
