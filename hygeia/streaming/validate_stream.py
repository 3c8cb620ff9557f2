"""Continuous validation (ST1-ST5) as a Structured Streaming job.

``readStream`` over the execution source -> only documents not yet validated
(S8/ST3) -> ``foreachBatch``: validate against the current rules (stateless
per document, so no state store) and write the verdict columns.

Exactly-once output: every micro-batch overwrites its own ``batch_id=<n>``
folder, so a batch replayed after a failure rewrites the same files; readers
take the latest verdict per execution (``latest_verdicts``).  Rules are
rebuilt per batch when ``refresh_rules`` is set (ST5), else built once.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hygeia.plans import validate as V
from hygeia.plans.rules import RuleSet

VERDICT_COLS = ["isValid", "invalidPayload", "fieldStatus", "invalid_names"]


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def validation_batch(rules_for: Callable[[], RuleSet], doc: Column, sink: str, as_of: str,
                     id_col: str = "exec_id", skip_seen: bool = True) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = batch.withColumn("_parsed", doc)
        # ST4: a document that can't be parsed is set aside with its row, the rest of the batch goes on
        bad = parsed.where(F.col("_parsed").isNull()).drop("_parsed")
        bad.write.mode("overwrite").parquet(f"{sink.rstrip('/')}_quarantine/batch_id={batch_id}")
        good = parsed.where(F.col("_parsed").isNotNull()).drop("_parsed")
        if skip_seen and _exists(spark, sink):  # ST3: ids that an earlier batch has validated
            seen = spark.read.parquet(sink)
            if "batch_id" in seen.columns:
                # a shuffle join: the ids seen so far grow with the stream and don't go to the driver
                good = good.join(seen.where(F.col("batch_id") != batch_id).select(id_col).distinct().hint("merge"), id_col, "left_anti")
        out = (V.validate(rules_for(), good, doc, id_col=id_col)
               .select(id_col, *VERDICT_COLS, F.lit(True).alias("validated"), F.lit(as_of).alias("validatedAt")))
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return run


def start(spark: SparkSession, source: DataFrame, rules: RuleSet | Callable[[], RuleSet], doc: Column,
          sink: str, checkpoint: str, as_of: str, available_now: bool = True,
          processing_time: str = "10 seconds", id_col: str = "exec_id", skip_seen: bool = True):
    """Start the validation stream; ``source`` is a streaming DataFrame (``spark.readStream...``)."""
    rules_for = rules if callable(rules) else (lambda: rules)
    pending = source
    if "validated" in source.columns:
        pending = pending.where(F.col("validated").isNull())  # ST3: already validated rows are skipped
    w = (pending.writeStream.foreachBatch(validation_batch(rules_for, doc, sink, as_of, id_col, skip_seen))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def latest_verdicts(spark: SparkSession, sink: str, id_col: str = "exec_id") -> DataFrame:
    """The current verdict per execution: the one from the latest micro-batch."""
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c != id_col]
    # the payload is no map and holds none: it can ride in the aggregate instead of a sorted window
    maps = F.map_entries("fieldStatus")
    packed = F.struct(*[maps.alias(c) if c == "fieldStatus" else F.col(c) for c in rest])
    last = df.groupBy(id_col).agg(F.max_by(packed, F.col("batch_id")).alias("_r"))
    return last.select(id_col, *[F.map_from_entries(F.col(f"_r.{c}")).alias(c) if c == "fieldStatus" else F.col(f"_r.{c}")
                                 for c in rest])
