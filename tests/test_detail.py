"""A stored snapshot as a reviewer opens it: header, data as found, changes by field, acceptance on reading."""

import pytest
from pyspark.sql import functions as F

from hygeia.plans import detail as D
from hygeia.plans import reports as RP
from hygeia.plans import snapshot as SN
from hygeia.sources import documents as DO

NOW = "2026-03-30T00:00:00.000000Z"


def _data(status, items=(), history=None, reason=None):
    return ([i["field"] for i in items], status, reason, [_item(i) for i in items], history or (NOW, "a", [], [], [], []), None)


def _item(i):
    metas = [(n, v, s, "p", []) for n, v, s in i.get("metadata", [])]
    return (i["field"], i.get("current"), i["value"], i.get("status", "invalid"), "p", [], metas)


@pytest.fixture(scope="module")
def snaps(spark):
    cpu = dict(field="CPUModel", value="x9", metadata=[("Family", "", "invalid"), ("coreCount", "64", "valid")])
    inst = dict(field="instanceType", value="m6", current="ON HOLD")
    hist = (NOW, "b", ["1", "2", None], ["3"], ["CPUModel", "Family", "CPUModel"], ["s"])
    rows = [("s1", "e1", "t", "c", [_data("pending", [cpu, inst], hist), _data("old")]),
            ("s2", "e2", None, None, [_data(None)]),
            ("s3", "e3", None, None, [_data("on hold", history=(None, None, None, None, None, None))]),
            ("s4", "e9", None, None, [_data("PENDING")]),
            ("s0", "e4", None, None, []),        # a snapshot without data is none
            ("s6", "e1", "t", "c", [_data("REJECTED")])]  # a second one of e1
    return spark.createDataFrame(rows, SN.SNAPSHOT_SCHEMA)


@pytest.fixture(scope="module")
def validated(spark):
    rows = [("e1", False), ("e2", True), ("e3", True), ("e4", True)]
    v = spark.createDataFrame(rows, "exec_id string, isValid boolean")
    return (v.withColumn("invalidPayload", F.array().cast("array<struct<field:string>>"))
            .withColumn("fieldStatus", F.create_map(F.lit("a"), F.lit("b"))))


def test_headers(spark, snaps, validated):
    docs = [("e1", '{"benchmarkType": "bt", "sutInstanceMetadata.sutType": " Cloud ", "sutInstanceMetadata": {"sutType": "x"}, "tester": 7}'),
            ("e2", '{"sutInstanceMetadata": {"sutType": "server"}, "createdOn": "2026"}'), ("e3", "{}"), ("e3", "{}"), ("e7", "{}")]
    ex = spark.createDataFrame(docs, "exec_id string, doc string").withColumn("doc", F.try_parse_json("doc"))
    got = {r["execution_id"]: r for r in D.headers(snaps, ex, F.col("doc"), validated).collect()}
    assert sorted(got) == ["e1", "e2", "e3", "e9"]
    e1 = got["e1"]
    assert (e1["snapshot_id"], e1["benchmark_type"], e1["benchmark_category"]) == ("s1", "bt", None)  # not the snapshot's own
    assert (e1["sut_type"], e1["tester"], e1["status"], e1["n_changed_fields"]) == (" Cloud ", "7", "pending", 2)
    assert (got["e2"]["sut_type"], got["e2"]["created_on"], got["e2"]["status"]) == ("server", "2026", "ACCEPTED")
    assert (got["e3"]["status"], got["e3"]["n_changed_fields"]) == ("on hold", 0)
    assert (got["e9"]["status"], got["e9"]["sut_type"]) == ("PENDING", None)


def test_existing_data(snaps):
    rows = [tuple(r) for r in D.existing_data(snaps).orderBy("execution_id", "field_pos", "data_pos").collect()]
    assert rows == [("e1", 0, "CPUModel", "invalid", 0, "CPUModel", "x9", "invalid"),
                    ("e1", 0, "CPUModel", "invalid", 1, "Family", "", "invalid"),
                    ("e1", 0, "CPUModel", "invalid", 2, "coreCount", "64", "valid"),
                    ("e1", 1, "instanceType", "ON HOLD", 0, "instanceType", "m6", "invalid")]


def test_changes_by_field(snaps):
    rows = [tuple(r) for r in D.changes_by_field(snaps).orderBy("execution_id", "field_pos").collect()]
    assert rows == [("e1", 0, "CPUModel", ["1", None], ["3", ""]), ("e1", 1, "Family", ["2"], [""])]


def test_accept_on_read(snaps, validated):
    new, cleared = D.accept_on_read(snaps, validated)
    rows = {r["execution_id"]: r["data"][0] for r in new.collect()}
    assert [*rows] == ["e2"]  # e3 is on hold, e9 is no known execution, e4's snapshot has no data
    assert (rows["e2"]["standardization_status"], rows["e2"]["lastModifiedOn"]) == ("ACCEPTED", None)
    assert {(r["exec_id"], r["isValid"], len(r["invalidPayload"]), r["fieldStatus"]) for r in cleared.collect()} == {
        ("e2", True, 0, None), ("e3", True, 0, None)}


def test_accepted_snapshot_keeps_its_columns(spark, snaps):
    """A batch sets status and stamp of an execution that passes; type, category and later elements stay."""
    v = (spark.createDataFrame([("e1", True, "new", "new")], "exec_id string, isValid boolean, benchmarkType string, benchmarkCategory string")
         .withColumn("invalid_names", F.array().cast("array<string>"))
         .withColumn("invalidPayload", F.array().cast("array<struct<field:string,value:string,validation_status:string,mapping:string,"
                                                      "metadata:array<struct<name:string,value:string,validation_status:string,mapping:string>>>>")))
    items = spark.createDataFrame([], "exec_id string, field_pos int, item_pos int, rank int, suggestion string, score double, "
                                      "overall_score double, status string, ml_id string")
    out = {r["snapshot_id"]: r for r in SN.upsert_snapshots(snaps, v, items, NOW).collect()}
    s1 = out["s1"]
    assert (s1["benchmark_type"], s1["benchmark_category"]) == ("t", "c")
    assert [d["standardization_status"] for d in s1["data"]] == ["ACCEPTED", "old"]
    assert len(out) == 6


def test_documents(spark):
    rows = [(1, '{"`_id`": "a", "id": "b", "type": "T", "status": "Published", "data": {"value": 5, "mapping": "m", "metadata": {"k": 64}}}'),
            (2, '{"`_id`": "", "id": "b", "data": {"metadata": "none"}}'), (3, '{"id": null, "_id": {"$oid": "c"}}'), (4, '[]')]
    df = spark.createDataFrame(rows, "k bigint, doc string").select("k", F.try_parse_json("doc").alias("doc"))
    got = {r["ordinal"]: r for r in DO.masterlist(df, F.col("doc"), F.col("k")).collect()}
    assert [got[k]["ml_id"] for k in (1, 2, 3, 4)] == ["a", "b", "c", None]
    assert (got[1]["data"]["value"], got[1]["data"]["metadata"], got[2]["data"]["metadata"]) == ("5", {"k": "64"}, None)
    ids = [('{"benchmarkExecutionID": "x", "_id": "y"}', "x"), ('{"_id": {"$oid": "z"}}', "z"), ('{"benchmarkExecutionID": "", "_id": "y"}', ""),
           ('{"benchmarkExecutionID": null, "_id": "y"}', None), ("broken", None)]
    docs = spark.createDataFrame(ids, "doc string, want string").withColumn("doc", F.try_parse_json("doc"))
    assert all(r["want"] == r["got"] for r in docs.select("want", DO.execution_id(F.col("doc")).alias("got")).collect())


def test_search_by_resolved_term(spark):
    ml = spark.createDataFrame([(1, "m", "Benchmark", "Published", ("SPEC CPU", "c", {"BenchmarkType": "intrate"}))],
                               "ordinal bigint, ml_id string, type string, status string, "
                               "data struct<value:string, mapping:string, metadata:map<string,string>>")
    resolved = RP.resolve_search(ml, "spec cpv", "benchmarkType", "benchmarkCategory")
    assert resolved == {"benchmarkCategory": "SPEC CPU"}
    item = "array<struct<field:string,value:string,validation_status:string,mapping:string,metadata:array<struct<name:string>>>>"
    rows = [("e1", False, ["CPUModel"], "intrate", "SPEC CPU", [("CPUModel", "b", "invalid", "p", [])]),
            ("e1", False, ["CPUModel"], "intrate", "SPEC CPU", [("CPUModel", "a", "invalid", "p", [])]),
            ("e2", False, ["CPUModel"], "intrate", "other", []), ("e3", True, [], "intrate", "SPEC CPU", [])]
    v = spark.createDataFrame(rows, "exec_id string, isValid boolean, invalid_names array<string>, benchmarkType string, "
                                    f"benchmarkCategory string, invalidPayload {item}")
    page = RP.invalid_records_page(v, "PENDING", "spec cpv", resolved=resolved)
    got = RP.payload_details(page, v).collect()
    assert [(r["execution_id"], r["total"], r["details"][0]["value"]) for r in got] == [("e1", 1, "a")]
    assert RP.invalid_records_page(v, "PENDING", "spec cpv").count() == 0
