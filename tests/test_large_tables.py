"""Steps whose figures must not grow faster than their input: no task gets one file, or all rows of a frequent text."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from hygeia.functions import fuzzy as FZ
from hygeia.plans import decisions as DC
from hygeia.plans import snapshot as SN
from hygeia.plans import validate as V
from hygeia.session import materialize as MATERIALIZE
from hygeia.sources import fixtures as FX


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1997, 3, 1)
    spark.createDataFrame([(i, f"part {i % 5}", "LARGE", i % 7) for i in range(20)],
                          "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, "O", day, "1-URGENT") for i in range(300)] + [(7, "F", day, "5-LOW")],
                          "o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
                          ).coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


def test_executions_are_spread_before_validation(spark, tables):
    ex = FX.executions(spark, tables)
    assert "BroadcastHashJoin" not in plan(ex) and "SortMergeJoin" in plan(ex)
    assert ex.count() == 301 and ex.where("exec_id = 7").count() == 2


def test_prior_snapshots_are_spread(spark, tables):
    seed = FX.snapshot_seed(spark, tables)
    assert "hashpartitioning" in plan(seed) and seed.count() == 301


def test_frequent_pairs_score_as_others(spark, monkeypatch):
    rows = [("16", "16")] * 50 + [("16", "32")] * 40 + [("abc", "abd"), ("abc", ""), (None, "x"), ("", ""), ("a" * 70, "a" * 69 + "b")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    want = {r["i"]: r["s"] for r in FZ.with_ratio(df, "a", "b", "s").collect()}
    monkeypatch.setattr(FZ, "sized_broadcast", lambda t: t)  # the table of pairs is too large for a broadcast
    monkeypatch.setattr(FZ, "HOT_ROWS", 45)
    got = FZ.with_ratio(df, "a", "b", "s")
    assert got.columns == ["i", "a", "b", "s"]
    assert sorted((r["i"], r["a"], r["b"]) for r in got.collect()) == sorted(((i, a, b) for i, (a, b) in enumerate(rows)))
    assert {r["i"]: r["s"] for r in got.collect()} == want
    assert want[0] == 1.0 and want[50] == 0.0 and want[90] == 0.6667 and want[91] == want[92] == want[93] == 0.0


def test_requirements_know_the_place_of_their_pair(spark):
    req = "array<struct<name:string,path:string,required:string,required_proc:string>>"
    cfg = spark.createDataFrame([([(5, "m", [("n", "p.q", "X", "x"), ("n", "other", "Y", "y")])],)],
                                f"cfgs array<struct<ordinal:long,ml_id:string,reqs:{req}>>")
    got = cfg.select(F.explode(V._placed("cfgs", [("a", "p"), ("n", "p.q")])).alias("c")).select(F.inline("c.reqs")).collect()
    assert [(r["path"], r["required_proc"], r["at"]) for r in got] == [("p.q", "x", 1), ("other", "y", -1)]


def test_approvals_are_folded_once(spark):
    d = ([], "PENDING", None, [("f", "invalid", "v", "invalid", "p", [(1, "w", 1.0, 1.0, "PENDING", "m")], [])],
         ("t", "u", [], [], [], []), None)
    snaps = spark.createDataFrame([("s1", "1", "O", "c", [d]), ("s2", "2", "O", "c", [d])], SN.SNAPSHOT_SCHEMA)
    at = datetime.datetime(2001, 1, 1)
    dec = spark.createDataFrame([(1, at, "approve", "1", "f", "w", None, "Approved", None, None, None, None)], DC.DECISION_SCHEMA)
    masterlist = spark.createDataFrame([], "ordinal long, type string, status string, "
                                           "data struct<value:string,mapping:string,metadata:map<string,string>>")
    out, upd = DC.apply_approvals(snaps, dec, masterlist, "now")
    assert [r["snapshot_id"] for r in out.collect()] == ["s1"]
    assert [(r["exec_id"], r["path"], r["value"]) for r in upd.orderBy("seq").collect()][0] == ("1", "p", "w")
    for df in (out, upd):  # both results read the written state
        assert df.inputFiles() and "aggregate(" not in plan(df)


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from hygeia.session import materialize
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "t"))
    known = kept.size()
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert out.count() == 7 and kept.size() <= known + 1  # +1: the count itself


def _snapshots(spark, *rows):
    def data(status, *fields):
        items = [(f, "invalid", "v", "invalid", "p", [(1, "w", 1.0, 1.0, "PENDING", "m")], [("g", "x", "invalid", "q", [])]) for f in fields]
        return ([], status, None, items, ("t", "u", [], [], [], []), None)
    return spark.createDataFrame([(sid, ex, "O", "c", [data(*d) for d in ds]) for sid, ex, *ds in rows], SN.SNAPSHOT_SCHEMA)


def _decisions(spark, *rows):
    return spark.createDataFrame([(i, datetime.datetime(2001, 1, day), kind, ex, field, value, None, status, None, None, None, None)
                                  for i, (day, kind, ex, field, value, status) in enumerate(rows)], DC.DECISION_SCHEMA)


def _rows(df):
    return sorted(map(repr, (r.asDict(recursive=True) for r in df.collect())))


def test_rejections_rewrite_rows_where_they_stand(spark, monkeypatch):
    from hygeia.operators.upsert import keyed_upsert
    own = [("s1", "1", ("PENDING", "f", "f")), ("s2", "2", ("pending", "f"), ("old", "h")), ("s3", "3", ("PENDING",)), ("s4", "4"), ("s5", "1", ("x", "f")),
           ("s6", None, ("PENDING", "f"))]
    shared = [("s7", "2", ("PENDING", "f")), ("s7", "9", ("PENDING", "f")), (None, "1", ("PENDING", "f")), (None, "8", ("PENDING", "f"))]
    dec = _decisions(spark, (1, "reject", "1", None, None, "Rejected"), (2, "reject", "1", None, None, "Again"), (1, "reject", "2", None, None, None),
                     (1, "reject", "4", None, None, "Rejected"), (1, "reject", None, None, None, "Rejected"), (1, "approve", "3", "f", "w", "Approved"))
    for rows in (own, own + shared):
        snaps = _snapshots(spark, *rows)
        want = keyed_upsert(snaps, DC.apply_rejections(snaps, dec, "now")[0], ["snapshot_id"])
        got = DC.rejected_snapshots(snaps, dec, "now")
        assert got.columns == snaps.columns and _rows(got) == _rows(want)
    upserts = []
    monkeypatch.setattr(DC, "keyed_upsert", lambda *a: upserts.append(a) or keyed_upsert(*a))
    out = DC.rejected_snapshots(_snapshots(spark, *own), dec, "now")
    assert not upserts and "LeftAnti" not in plan(out) and out.where("data[0].standardization_status = 'REJECTED'").count() == 3


def test_the_items_of_a_snapshot_are_shuffled_once(spark):
    seed = spark.createDataFrame([(2, "S1", "pending", "t"), (4, "S2", "ACCEPTED", "t"), (6, "S3", "PENDING", "t")],
                                 "exec_id long, snapshot_id string, status string, updated_on string")
    meta = "array<struct<name:string,value:string,validation_status:string,mapping:string>>"
    v = spark.createDataFrame([(2, False, ["f"], [("f", "v", "invalid", "p", [("m", "x", "invalid", "q")])]), (3, True, [], []), (6, True, [], [])],
                              f"exec_id long, isValid boolean, invalid_names array<string>, invalidPayload array<struct<field:string,value:string,"
                              f"validation_status:string,mapping:string,metadata:{meta}>>")
    v = v.withColumn("benchmarkType", F.lit("O")).withColumn("benchmarkCategory", F.lit("c"))
    items = spark.createDataFrame([(2, 0, -1, 1, "w", 0.5, 0.7, "PENDING", "m1"), (2, 0, 0, 1, "y", 0.1, 0.7, "PENDING", "m1")],
                                  "exec_id long, field_pos int, item_pos int, rank int, suggestion string, score double, overall_score double, "
                                  "status string, ml_id string")
    out = SN.upsert_snapshots(SN.seed_snapshots(seed), v, items, "now")
    text = plan(out)
    # partial and final, in one place; no exchange by the number
    assert text.count("collect_list") == 2 and not re.search(r"hashpartitioning\(\w+#\d+L", text)
    got = {r["snapshot_id"]: r for r in out.collect()}
    assert {k: r["data"][0]["standardization_status"] for k, r in got.items()} == {"S1": "PENDING", "S2": "ACCEPTED", "S3": "ACCEPTED"}
    it = got["S1"]["data"][0]["invalidValues"][0]
    assert it["comparingData"][0]["suggestion"] == "w" and it["metadata"][0]["comparingData"][0]["suggestion"] == "y"


def test_a_batch_of_decisions_is_one_pass(spark, monkeypatch):
    own = [("s1", "1", ("PENDING", "f", "h")), ("s2", "2", ("pending", "f"), ("old", "h")), ("s3", "3", ("PENDING",)), ("s4", "4"),
           ("s5", "1", ("x", "h")), ("s6", None, ("PENDING", "f")), ("s7", "7", ("PENDING", "f", "cpumodel")), ("s8", "8", ("PENDING", "cpumodel"))]
    shared = [("s9", "2", ("PENDING", "f")), ("s9", "9", ("PENDING", "h")), (None, "1", ("PENDING", "f")), (None, "8", ("PENDING", "cpumodel"))]
    dec = _decisions(spark, (1, "approve", "1", "f", "w", "Approved"), (2, "approve", "1", "g", "z", None), (3, "reject", "1", None, None, "Rejected"),
                     (1, "reject", "2", None, None, "Rejected"), (2, "approve", "2", "f", "other", "Approved"), (1, "reject", "4", None, None, None),
                     (1, "approve", "3", "f", "w", None), (1, "approve", "7", "f", "w", None), (1, "approve", None, "f", "w", None),
                     (1, "reject", None, None, None, None), (1, "draft", "8", None, None, None), (1, "reject", "9", None, None, "Rejected"))
    ml = "ordinal long, type string, status string, data struct<value:string,mapping:string,metadata:map<string,string>>"
    masterlist = spark.createDataFrame([(1, "F", "Published", ("other", "p", {"G": "filled"}))], ml)
    drafted = spark.createDataFrame([(2, "CPUModel", "Draft", ("n", "p", {}), "7"), (3, "CPUModel", "Draft", ("v", "p", {}), None),
                                     (4, "h", "Draft", ("n", "p", {}), "9")], f"{ml}, execution_id string")
    review = lambda rows: DC.review_snapshots(_snapshots(spark, *rows), dec, masterlist, drafted, "now")
    in_place = DC._in_place
    monkeypatch.setattr(DC, "_in_place", lambda snapshots, by_row, by_id: by_id(snapshots))  # an upsert after each of three steps
    want = {len(rows): _rows(review(rows)) for rows in (own, own + shared)}
    monkeypatch.setattr(DC, "_in_place", in_place)
    assert _rows(review(own + shared)) == want[len(own + shared)]
    monkeypatch.setattr(DC, "_upsert", None)
    out = review(own)
    assert plan(out).count("aggregate(") == 1  # folded once
    assert _rows(out) == want[len(own)]
    status = {r["snapshot_id"]: r["data"][0] and r["data"][0]["standardization_status"] for r in out.where("size(data) > 0").collect()}
    assert status == {"s1": "REJECTED", "s2": "ACCEPTED", "s3": "PENDING", "s4": None, "s5": "REJECTED", "s6": "PENDING", "s7": "ON HOLD", "s8": "ON HOLD"}


def test_items_of_a_detail_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(SN, "materialize", lambda df, name: written.append((name, df)) or MATERIALIZE(df, name))
    sigs = spark.createDataFrame([("f", 1, "word", "word x", {"g": "y"})],
                                 "field string, ordinal long, primary_value string, signature string, metadata map<string,string>")
    rules = type("Rules", (), {"signatures": sigs})
    snaps = _snapshots(spark, ("s1", "1", ("PENDING", "f")), ("s2", "2", ("pending",)), ("s3", "3"), ("s4", "4", ("REJECTED", "f", "h")))
    snaps = snaps.withColumn("data", F.transform("data", lambda d: d.withField("invalidValues", F.transform(
        d["invalidValues"], lambda it: it.withField("value", F.lit("word"))))))
    v = spark.createDataFrame([(1, True), (2, True), (4, True), (4, False)], "exec_id long, isValid boolean")
    out = SN.snapshot_detail(rules, snaps, v)
    items = dict(written)["detail_items"]
    assert "ml_id" not in plan(items) and items.count() == 5  # f of 1, f and h of 4 twice: no stored suggestions of metadata, no empty snapshots
    rows = sorted((r["execution_id"], r["snapshot_status"], r["item"], r["name"], r["suggestion"], r["score"]) for r in out.collect())
    meta, prim = ("metadata", "g", "y", 0.0), ("primary", "f", "word", 1.0)
    assert rows == [("1", "ACCEPTED", *meta), ("1", "ACCEPTED", *prim)] + [("4", "REJECTED", *meta)] * 2 + [("4", "REJECTED", *prim)] * 2


def test_joins_with_written_tables_go_by_their_rows(spark, monkeypatch):
    from hygeia import session
    t = session.materialize(spark.range(50).withColumn("x", F.lit("y")), "few")
    assert "BroadcastHashJoin" in plan(spark.range(9).join(session.measured(t), "id", "left"))
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 49)
    assert "SortMergeJoin" in plan(spark.range(9).join(session.measured(t), "id", "left"))  # however small the file


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    from hygeia.operators.buckets import KeyedTable
    rows = spark.range(4000).select("id", F.col("id").alias("n"), F.lit("a").alias("x"))
    t = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["id"], "n", 2)
    assert t.merge(rows, 0) == [0, 1]
    files = t.read().inputFiles()
    assert len(files) == 8 and all(sum(f"_bucket={b}/" in f for f in files) == 4 for b in (0, 1))  # 8 partitions, 2 buckets
    assert t.merge(rows.where("id % 2 = 0").withColumn("n", F.col("n") + F.col("id") % 4 - 1).withColumn("x", F.lit("b")), 1) == [0, 1]
    got = {r["id"]: r["x"] for r in t.read().collect()}
    assert len(got) == 4000 and all((x == "b") == (i % 4 == 2) for i, x in got.items())


def test_only_tied_rows_have_a_digest(spark):
    from hygeia.operators.buckets import digest_of_ties
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 1, "d"), (2, 1, "d"), (None, None, "e"), (None, None, "f")],
                                 "k int, n int, x string")
    got = {(r["k"], r["x"]): r["_tie"] == r["all"] for r in digest_of_ties(rows, ["k", "n"], ["x"])
           .withColumn("all", F.xxhash64(F.to_json(F.struct("x")))).collect()}
    assert got == {(1, "a"): False, (1, "b"): False, (2, "c"): True, (2, "d"): True, (None, "e"): True, (None, "f"): True}


def test_changes_are_known_on_disk_and_batches_leave_no_tables(spark, tmp_path, monkeypatch):
    from hygeia.streaming import change_stream as CS
    written = []
    monkeypatch.setattr(CS, "materialize", lambda df, name: written.append(MATERIALIZE(df, name)) or written[-1])
    monkeypatch.setattr(CS.V, "validate", lambda rules, df, doc: df.withColumn("invalidPayload", F.lit("")).withColumn("isValid", F.lit(True))
                        .withColumn("fieldStatus", F.lit("")))
    rows = [(1, 1, "insert", "a"), (1, 2, "update", "b"), (2, 1, "insert", "c"), (1, 2, "update", "b"), (3, 1, "delete", "d"), (4, 1, "insert", None)]
    src = spark.createDataFrame([(i, n, op, d, None, None) for i, n, op, d in rows],
                                "exec_id long, change_no long, op string, doc string, isValid boolean, validated boolean")
    for part in ("0", "1"):  # the second file is a replay
        src.coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
    table = CS.executions_table(spark, str(tmp_path / "t"), src.select("exec_id", "change_no", "doc").schema, CS.verdict_fields({}, src, F.col("doc")), 2)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "source"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    CS.start(stream, table, F.col("doc"), str(tmp_path), "now", rules={}).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before and "HDFS" in before
    assert sorted((r["exec_id"], r["change_no"], r["doc"]) for r in table.read().collect()) == [(1, 2, "b"), (2, 1, "c")]
    assert list((tmp_path / "checkpoint").glob("state/0/*/*.zip")) and not list((tmp_path / "checkpoint").glob("state/0/*/*.delta"))
    import os
    assert len(written) >= 4 and not any(os.path.exists(f.removeprefix("file:")) for df in written for f in df.inputFiles())
