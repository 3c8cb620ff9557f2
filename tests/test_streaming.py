"""Property: the streaming validation equals the batch validation on the same input."""

import uuid

from pyspark.sql import functions as F

from hygeia.functions.paths import to_doc_variant
from hygeia.plans import rules as R
from hygeia.plans import validate as V
from hygeia.session import checkpoint_dir
from hygeia.streaming import validate_stream as ST
from tests import golden as G


def test_stream_equals_batch(spark):
    ml = spark.createDataFrame(G.masterlist_rows(), G.ML_SCHEMA)
    raw = spark.createDataFrame(G.execution_rows(), "exec_id string, doc string")
    doc = to_doc_variant(F.col("doc"), "json")
    proc = spark.createDataFrame(G.PROC_ROWS, "cpuModelNo string, family string, ordinal bigint")
    rules = R.build_rules(ml, raw.withColumn("doc", doc), F.col("doc"), proc)
    batch = {r["exec_id"]: (r["isValid"], list(r["invalid_names"]))
             for r in V.validate(rules, raw, doc).collect()}
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-test-{uuid.uuid4().hex}"
    raw.repartition(3).write.parquet(f"{root}/src")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/src")
    q = ST.start(spark, stream, rules, doc, f"{root}/sink", f"{root}/ckpt", "2026-03-30T00:00:00.000000Z")
    q.awaitTermination()
    streamed = {r["exec_id"]: (r["isValid"], list(r["invalid_names"]))
                for r in ST.latest_verdicts(spark, f"{root}/sink").collect()}
    assert streamed == batch
    assert batch["e1"] == (True, [])


def test_malformed_rows_and_known_ids(spark):
    """A malformed document is set aside; an id of an earlier batch is not validated again."""
    ml = spark.createDataFrame(G.masterlist_rows(), G.ML_SCHEMA)
    rows = G.execution_rows()
    raw = spark.createDataFrame(rows, "exec_id string, doc string")
    doc = to_doc_variant(F.col("doc"), "json")
    proc = spark.createDataFrame(G.PROC_ROWS, "cpuModelNo string, family string, ordinal bigint")
    rules = R.build_rules(ml, raw.withColumn("doc", doc), F.col("doc"), proc)
    sink = f"{checkpoint_dir(spark).rstrip('/')}/stream-test-{uuid.uuid4().hex}/sink"
    run = ST.validation_batch(lambda: rules, doc, sink, "2026-03-30T00:00:00.000000Z")
    run(spark.createDataFrame(rows[:2] + [("bad", "{oops")], "exec_id string, doc string"), 0)
    run(spark.createDataFrame(rows[1:3], "exec_id string, doc string"), 1)
    run(spark.createDataFrame(rows[1:3], "exec_id string, doc string"), 1)  # a replay
    assert [r["exec_id"] for r in spark.read.parquet(f"{sink}_quarantine").collect()] == ["bad"]
    got = {r["exec_id"]: r["batch_id"] for r in ST.latest_verdicts(spark, sink).collect()}
    assert got == {rows[0][0]: 0, rows[1][0]: 0, rows[2][0]: 1}
