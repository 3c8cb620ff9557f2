"""Changes of documents through the stream: state, write-back and rules that change while it runs."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from hygeia.functions.paths import to_doc_variant
from hygeia.operators.buckets import KeyedTable
from hygeia.plans import rules as R
from hygeia.plans import validate as V
from hygeia.session import checkpoint_dir
from hygeia.streaming import change_stream as CS
from tests import golden as G

AS_OF = "2026-03-30T00:00:00.000000Z"
CHANGE = "exec_id string, change_no bigint, op string, doc string, isValid boolean, validated boolean"


def _doc():
    return to_doc_variant(F.col("doc"), "json")


def _folder(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/changes-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def base(spark):
    ml = spark.createDataFrame(G.masterlist_rows(), G.ML_SCHEMA)
    proc = spark.createDataFrame(G.PROC_ROWS, "cpuModelNo string, family string, ordinal bigint")
    raw = spark.createDataFrame(G.execution_rows(), "exec_id string, doc string")
    rules = R.build_rules(ml, raw.withColumn("doc", _doc()), F.col("doc"), proc)
    return ml, proc, raw, rules


def _table(spark, root, raw, rules, buckets=5):
    documents = spark.createDataFrame([], "exec_id string, change_no bigint, doc string").schema
    return CS.executions_table(spark, f"{root}/executions", documents, CS.verdict_fields(rules, raw, _doc()), buckets)


def _rows(table):
    return {r["exec_id"]: r for r in table.read().collect()}


def test_keyed_table_rewrites_touched_buckets_only(spark):
    schema = spark.createDataFrame([], "k bigint, no bigint, v string").schema
    t = KeyedTable(spark, _folder(spark), schema, ["k"], "no", 7)
    assert t.read().collect() == []
    t.merge(spark.createDataFrame([(i, 1, f"a{i}") for i in range(100)] + [(None, 1, "none")], schema), 0)
    first = t.state()
    hit = t.merge(spark.createDataFrame([(3, 2, "b3"), (3, 1, "c3"), (200, 1, "new")], schema), 1)
    assert len(hit) <= 2 and {b for b, v in t.state().items() if v == 1} == set(hit)
    assert all(t.state()[b] == first[b] for b in first if b not in hit)
    expected = {i: f"a{i}" for i in range(100)} | {None: "none", 3: "b3", 200: "new"}
    assert {r["k"]: r["v"] for r in t.read().collect()} == expected and t.read().count() == 102
    # outdated, repeated and empty changes; the newest version run again
    t.merge(spark.createDataFrame([(3, 1, "old"), (4, 1, "same number"), (None, 1, "x")], schema), 2)
    for _ in range(2):
        t.merge(spark.createDataFrame([(5, 9, "z")], schema), 3)
    t.merge(spark.createDataFrame([], schema), 4)
    assert {r["k"]: r["v"] for r in t.read().collect()} == expected | {5: "z"} and t.read().count() == 102
    assert {r["k"]: r["v"] for r in t.read(0).collect()}[3] == "a3"
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(5, 10, "late")], schema), 3)
    assert t.vacuum(keep=1) and {r["k"]: r["v"] for r in t.read().collect()} == expected | {5: "z"}


def test_stored_rows_come_from_touched_buckets(spark):
    schema = spark.createDataFrame([], "k bigint, no bigint").schema
    t = KeyedTable(spark, _folder(spark), schema, ["k"], "no", 50)
    t.merge(spark.createDataFrame([(i, 0) for i in range(500)], schema), 0)
    got = t.stored(spark.createDataFrame([(7, 1), (9999, 1)], schema))
    assert [tuple(r) for r in got.collect()] == [(7, 0)]
    assert len(got.inputFiles()) <= 2


def test_changes_equal_batch_validation(spark, base):
    """Inserts, an update, a replay, an outdated change, a malformed document, flags: the table holds the verdict of the last state."""
    ml, proc, raw, rules = base
    root, rows = _folder(spark), G.execution_rows()
    ids = [r[0] for r in rows]
    docs = dict(rows)
    changes = [[(i, 1, "insert", d, None, None) for i, d in rows[:3]] + [("bad", 1, "insert", "{oops", None, None)],
               [(ids[0], 3, "update", docs[ids[1]], None, None), (ids[1], 2, "replace", docs[ids[2]], None, None),
                (ids[2], 1, "insert", docs[ids[2]], None, None), (None, 1, "insert", docs[ids[2]], None, None)],
               [(ids[0], 2, "update", docs[ids[2]], None, None), (ids[0], 3, "update", docs[ids[1]], None, None),
                (ids[1], 4, "delete", None, None, None), (ids[2], 5, "update", docs[ids[0]], True, True)]
               + [(i, 1, "insert", d, None, None) for i, d in rows[3:]]]
    for n, part in enumerate(changes):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.parquet(f"{root}/source/part={n}")
        table = _table(spark, root, raw, rules)
        stream = spark.readStream.schema(CHANGE).parquet(f"{root}/source/part=*")
        CS.start(stream, table, _doc(), root, AS_OF, rules=rules).awaitTermination()
    state = docs | {ids[0]: docs[ids[1]], ids[1]: docs[ids[2]]}
    want = V.validate(rules, spark.createDataFrame(list(state.items()), "exec_id string, doc string"), _doc()).collect()
    got = _rows(table)
    assert {i: (r["isValid"], r["invalidPayload"], r["fieldStatus"]) for i, r in got.items()} == {
        r["exec_id"]: (r["isValid"], r["invalidPayload"], r["fieldStatus"]) for r in want}
    assert (got[ids[0]]["change_no"], got[ids[1]]["change_no"], got[ids[2]]["change_no"]) == (3, 2, 1)
    assert all(r["validated"] and r["validatedAt"] == AS_OF for r in got.values())
    assert [r["exec_id"] for r in spark.read.parquet(f"{root}/quarantine").collect()] == ["bad"]


def test_batch_run_again(spark, base):
    ml, proc, raw, rules = base
    root, rows = _folder(spark), G.execution_rows()
    table = _table(spark, root, raw, rules)
    run = CS.change_batch(table, _doc(), root, AS_OF, rules_for=lambda c: R.build_rules(ml, None, None, proc, counts_for=c))
    a = spark.createDataFrame([(i, 1, "insert", d, None, None) for i, d in rows], CHANGE)
    b = spark.createDataFrame([(rows[0][0], 2, "update", rows[1][1], None, None)], CHANGE)
    run(a, 0)
    run(b, 1)
    once, counts = _rows(table), CS.TypeCounts(spark, f"{root}/counts").total(2)
    run(b, 1)
    assert _rows(table) == once and CS.TypeCounts(spark, f"{root}/counts").total(2) == counts
    # kept counts equal those of a scan of the executions as they are now
    assert counts == R.type_counts(table.read(), _doc(), list(counts))


def test_poll_takes_neither_flag(spark):
    rows = [("a", 1, "insert", "{}", None, None), ("b", 1, "insert", "{}", False, None), ("c", 1, "insert", "{}", None, True)]
    d = spark.createDataFrame(rows, CHANGE)
    assert [r["exec_id"] for r in CS.pending(d, poll=True).collect()] == ["a"]
    assert sorted(r["exec_id"] for r in CS.pending(d).collect()) == ["a", "b"]


def test_rules_change_in_mid_stream(spark, base):
    """A value published between two batches is valid in the second; types follow all documents so far, also of a new path."""
    ml, proc, raw, _ = base
    root = _folder(spark)
    bench = dict(json.loads(G.execution_rows()[0][1]))
    lists = {"now": ml.where("false")}
    rules_for = lambda c: R.build_rules(lists["now"], None, None, proc, counts_for=c)
    table = _table(spark, root, raw, base[3])
    run = CS.change_batch(table, _doc(), root, AS_OF, rules_for=rules_for)
    lists["now"] = ml
    cpu = bench["platformProfile"]["sut"]["Summary"]["Server"]
    doc = lambda v: json.dumps({**bench, "platformProfile": {**bench["platformProfile"], "sut": {
        **bench["platformProfile"]["sut"], "Summary": {**bench["platformProfile"]["sut"]["Summary"],
                                                       "Server": {**cpu, "CPUModel": v}}}}})
    run(spark.createDataFrame([("x", 1, "insert", doc("Newcomer 1"), None, None)], CHANGE), 0)
    assert "CPUModel" in {e["field"] for e in _rows(table)["x"]["invalidPayload"]}
    template = next(r for r in ml.where("type = 'CPUModel'").collect())
    data = template["data"].asDict() | {"value": "Newcomer 1", "metadata": {}}
    extra = spark.createDataFrame([(10_000, "new", template["type"], "Published", tuple(data[f] for f in ml.schema["data"].dataType.names)),
                                   (10_001, "n2", "Serial", "Published", ("7", "serial", {}))], ml.schema)
    lists["now"] = ml.unionByName(extra)
    run(spark.createDataFrame([("y", 1, "insert", doc("Newcomer 1"), None, None),
                               ("z", 1, "insert", json.dumps({"serial": "007"}), None, None)], CHANGE), 1)
    got = _rows(table)
    assert "CPUModel" not in {e["field"] for e in got["y"]["invalidPayload"]}
    assert "CPUModel" in {e["field"] for e in got["x"]["invalidPayload"]}  # not changed since: not validated again
    assert CS.TypeCounts(spark, f"{root}/counts").total(2)["serial"] == (1, 0)
    assert "Serial" not in {e["field"] for e in got["z"]["invalidPayload"]}  # an integer field: 007 is 7


def test_drafts_are_appended_once(spark, base):
    ml = base[0]
    t = KeyedTable(spark, _folder(spark), ml.schema, ["ml_id"], None, 3)
    t.merge(ml, 0)
    template = ml.first()
    draft = spark.createDataFrame([(20_000, "draft-1", template["type"], "Draft", template["data"])], ml.schema)
    for _ in range(2):
        CS.append_drafts(t, draft, 1)
    CS.append_drafts(t, draft, 2)
    assert t.read().count() == ml.count() + 1
    assert t.read().where("status = 'Draft' and ml_id = 'draft-1'").count() == 1
