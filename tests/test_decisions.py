"""Review decisions on the golden dataset (FIXTURES.md section 2.4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hygeia.functions.paths import to_doc_variant
from hygeia.plans import decisions as D
from hygeia.plans import rules as R
from hygeia.plans import snapshot as SN
from hygeia.plans import suggest as SG
from hygeia.plans import validate as V
from tests import golden as G

AS_OF = "2026-03-30T00:00:00.000000Z"


@pytest.fixture(scope="module")
def state(spark):
    ml = spark.createDataFrame(G.masterlist_rows(), G.ML_SCHEMA)
    ex = spark.createDataFrame(G.execution_rows(), "exec_id string, doc string")
    ex = (ex.withColumn("doc", to_doc_variant(F.col("doc"), "json"))
          .withColumn("benchmarkType", F.lit("intrate")).withColumn("benchmarkCategory", F.lit("SPEC CPU")))
    proc = spark.createDataFrame(G.PROC_ROWS, "cpuModelNo string, family string, ordinal bigint")
    rules = R.build_rules(ml, ex, F.col("doc"), proc)
    val = V.validate(rules, ex, F.col("doc")).cache()
    items = SG.suggestion_items(SG.record_suggestions(rules, val))
    prev = spark.createDataFrame([], SN.SNAPSHOT_SCHEMA)
    snaps = SN.upsert_snapshots(prev, val, items, AS_OF, "tester").cache()
    return spark, ml, snaps


def _dec(spark, rows):
    full = []
    for r in rows:
        base = dict(decision_id=1, ts=dt.datetime(2026, 3, 30), kind=None, execution_id=None, field_name=None,
                    accepted_value=None, rank=None, current_status=None, core_count=None, type=None, value=None,
                    metadata=None)
        base.update(r)
        full.append(tuple(base[k] for k in ["decision_id", "ts", "kind", "execution_id", "field_name",
                                             "accepted_value", "rank", "current_status", "core_count", "type",
                                             "value", "metadata"]))
    return spark.createDataFrame(full, D.DECISION_SCHEMA)


def test_approve_suggestion_cascades_last_rank(state):
    spark, ml, snaps = state
    dec = _dec(spark, [dict(kind="approve", execution_id="e3", field_name="CPUModel", accepted_value="7543",
                            current_status="Approved")])
    out, upd = D.apply_approvals(snaps, dec, ml, AS_OF)
    d = out.first()["data"][0]
    h = d["history"]
    assert list(h["valueField"]) == ["CPUModel", "Family", "coreCount"]
    assert list(h["from"]) == ["AMD 7543", "", "32"]
    assert list(h["to"]) == ["7543", "Milan", "64"]
    assert list(h["source"]) == ["suggestion"] * 3
    assert d["standardization_status"] == "ACCEPTED"
    sts = [(c["rank"], c["status"]) for c in d["invalidValues"][0]["comparingData"]]
    assert sts == [(1, "Accepted"), (2, "Accepted"), (3, "Rejected")]
    ups = {(r["path"], r["value"]) for r in upd.collect()}
    assert ("platformProfile.sut.Summary.Server.CPUModel", "7543") in ups
    assert ("isValid", "true") in ups


def test_approve_with_rank(state):
    spark, ml, snaps = state
    dec = _dec(spark, [dict(kind="approve", execution_id="e3", field_name="CPUModel", accepted_value="7543", rank=1)])
    out, _ = D.apply_approvals(snaps, dec, ml, AS_OF)
    assert list(out.first()["data"][0]["history"]["to"]) == ["7543", "Milan", "32"]


def test_approve_dropdown_without_record(state):
    spark, ml, snaps = state
    dec = _dec(spark, [dict(kind="approve", execution_id="e3", field_name="CPUModel", accepted_value="9999")])
    d = D.apply_approvals(snaps, dec, ml, AS_OF)[0].first()["data"][0]
    assert list(d["history"]["source"]) == ["dropdown"] * 3
    assert list(d["history"]["to"]) == ["9999", "", "32"]
    assert all(c["status"] == "Rejected" for c in d["invalidValues"][0]["comparingData"])
    assert d["standardization_status"] == "ACCEPTED"


def test_reject(state):
    spark, ml, snaps = state
    dec = _dec(spark, [dict(kind="reject", execution_id="e4", current_status="Rejected")])
    out, upd = D.apply_rejections(snaps, dec, AS_OF)
    d = out.first()["data"][0]
    assert d["standardization_status"] == "REJECTED" and d["reason"] == "L0 Junk Data."
    assert list(d["history"]["valueField"]) == ["instanceType", "cloudProvider"]
    assert list(d["history"]["from"]) == ["m6a-large", "AWS"] == list(d["history"]["to"])
    assert list(d["history"]["source"]) == ["reject", "reject"]
    assert upd.first()["path"] == "entitliment_level"


def test_draft_duplicate_and_hold(state):
    spark, ml, snaps = state
    dup = _dec(spark, [dict(kind="draft", type="cpumodel", value="AMD 7543", metadata={})])
    assert D.draft_records(ml, dup, AS_OF).count() == 0
    new = _dec(spark, [dict(kind="draft", type="cpumodel", value="AMD 7543", metadata={"Family": "Milan"})])
    drafted = D.draft_records(ml, new, AS_OF)
    r = drafted.first()
    assert (r["type"], r["status"], r["data"]["value"]) == ("CPUModel", "Draft", "AMD 7543")
    held = D.hold_snapshots(snaps, drafted, AS_OF).collect()
    assert [h["execution_id"] for h in held] == ["e3"]
    d = held[0]["data"][0]
    assert d["standardization_status"] == "ON HOLD"
    assert all(c["status"] == "REJECTED" for c in d["invalidValues"][0]["comparingData"])


def test_snapshot_detail_carries_saved_status(state):
    spark, ml, snaps = state
    from hygeia.plans import rules as R2
    dec = _dec(spark, [dict(kind="approve", execution_id="e3", field_name="CPUModel", accepted_value="7543")])
    approved, _ = D.apply_approvals(snaps, dec, ml, AS_OF)
    approved = spark.createDataFrame(approved.collect(), approved.schema)  # small: cut the lineage
    ex = spark.createDataFrame(G.execution_rows(), "exec_id string, doc string")
    ex = ex.withColumn("doc", to_doc_variant(F.col("doc"), "json"))
    proc = spark.createDataFrame(G.PROC_ROWS, "cpuModelNo string, family string, ordinal bigint")
    rules = R2.build_rules(ml, ex, F.col("doc"), proc)
    detail = SN.snapshot_detail(rules, approved).collect()
    got = sorted((r["rank"], r["suggestion"], r["status"], r["score"]) for r in detail if r["item"] == "primary")
    assert got == [(1, "7543", "Accepted", 0.6667), (2, "7543", "Accepted", 0.6667), (3, "9654P", "Rejected", 0.3077)]
    meta = {(r["rank"], r["name"]): (r["suggestion"], r["score"]) for r in detail if r["item"] == "metadata"}
    assert meta[(2, "coreCount")] == ("64", 0.0)
    assert meta[(1, "coreCount")] == ("32", 1.0)


def test_every_approval_of_a_batch_counts(state):
    """Two fields of one record approved in one batch, the second a metadata name of the first's item."""
    spark, ml, snaps = state
    dec = _dec(spark, [dict(decision_id=2, kind="approve", execution_id="e3", field_name="coreCount", accepted_value="99"),
                       dict(decision_id=1, kind="approve", execution_id="e3", field_name="CPUModel", accepted_value="7543"),
                       dict(decision_id=3, kind="approve", execution_id="e3", field_name="noSuchField", accepted_value="x")])
    out, upd = D.apply_approvals(snaps, dec, ml, AS_OF)
    d = out.first()["data"][0]
    assert list(d["history"]["valueField"]) == ["CPUModel", "Family", "coreCount", "coreCount"]
    assert list(d["history"]["to"]) == ["7543", "Milan", "64", "99"]
    assert d["history"]["source"][-1] == "dropdown" and d["standardization_status"] == "ACCEPTED"
    last = {}
    for r in sorted(upd.collect(), key=lambda r: r["seq"]):
        last[r["path"]] = r["value"]
    assert last["isValid"] == "true" and last["platformProfile.sut.Summary.CPU.CPU(s)"] == "99"
    assert last["platformProfile.sut.Summary.Server.CPUModel"] == "7543"


def test_metadata_alone_leaves_the_record_pending(state):
    spark, ml, snaps = state
    dec = _dec(spark, [dict(kind="approve", execution_id="e3", field_name="coreCount", accepted_value="64")])
    out, upd = D.apply_approvals(snaps, dec, ml, AS_OF)
    d = out.first()["data"][0]
    assert d["standardization_status"] == "PENDING" and list(d["history"]["valueField"]) == ["coreCount"]
    assert d["invalidValues"][0]["validation_status"] == "invalid"
    assert [(r["path"], r["value"]) for r in upd.collect()] == [("platformProfile.sut.Summary.CPU.CPU(s)", "64")]


def test_complete_table_after_a_batch(state):
    spark, ml, snaps = state
    dec = _dec(spark, [dict(decision_id=1, kind="approve", execution_id="e3", field_name="CPUModel", accepted_value="7543"),
                       dict(decision_id=2, kind="reject", execution_id="e4")])
    none = D.draft_records(ml, dec, AS_OF)
    out = {r["execution_id"]: r["data"][0]["standardization_status"]
           for r in D.review_snapshots(snaps, dec, ml, none, AS_OF).collect()}
    before = {r["execution_id"]: r["data"][0]["standardization_status"] for r in snaps.collect()}
    assert out == {**before, "e3": "ACCEPTED", "e4": "REJECTED"}


def test_document_overlay(spark):
    from hygeia.operators.upsert import apply_document_updates
    ex = spark.createDataFrame([("1", ("x", (5, "k"))), ("2", ("y", None))], "exec_id string, doc struct<`a.b`:string,a:struct<b:int,c:string>>")
    up = spark.createDataFrame([("1", "a.b", "8", 1), ("1", "a.b", "9", 2), ("1", "new.level", "v", 1)],
                               "exec_id string, path string, value string, seq int")
    got = {r["exec_id"]: r["doc"].asDict(True) for r in apply_document_updates(ex, up).collect()}
    assert got["1"] == {"a.b": "9", "a": {"b": 9, "c": "k"}, "new": {"level": "v"}}
    assert got["2"]["a.b"] == "y" and got["2"]["new"]["level"] is None
    js = spark.createDataFrame([("1", '{"a.b":1,"q":[1]}'), ("2", "{}")], "exec_id string, doc string")
    assert {r["exec_id"]: r["doc"] for r in apply_document_updates(js, up).collect()} == {
        "1": '{"a.b": "9", "q": [1], "a": {"b": "9"}, "new": {"level": "v"}}', "2": "{}"}
    v = js.withColumn("doc", F.parse_json("doc"))
    assert {r["exec_id"]: r["t"] for r in apply_document_updates(v, up).select("exec_id", F.to_json("doc").alias("t")).collect()}["1"] \
        == '{"a":{"b":"9"},"a.b":"9","new":{"level":"v"},"q":[1]}'
