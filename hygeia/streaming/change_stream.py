"""Validation of a stream of changes, with verdicts written back onto the executions (S7, S8, S10, ST1, ST3, ST5).

A change is (exec_id, change_no, op, doc, isValid, validated): ``doc`` is the whole document after an insert, a replace or an
update, and change numbers grow with time.  Changes of other kinds, and those whose document was validated before (the
write-back itself is such a change), are passed over.

- Known changes: the stream keeps the (exec_id, change_no) it has seen in its state store (``dropDuplicates``; Spark's, next to the
  checkpoint), so a change that the source delivers again is dropped without reading any earlier output.
- Changed documents: a change of a known id has a number of its own, so it is validated again.  Within a batch the last change of an
  id stands for it; a change older than what the table holds is dropped, in whatever batch it comes.
- Write-back: executions are a ``KeyedTable``; a batch rewrites the buckets it touches and carries the five verdict columns.
- Rules: with ``rules_for(counts_for)`` they are derived anew for each batch.  Field types need counts over all executions: these
  are kept per path, one small table per batch holding what the batch adds and takes away (rows that replace others take theirs
  away).  A path that no batch has counted yet is counted over the table once.

Cases: a document that can't be parsed goes to ``quarantine``, whatever its id; null ids are passed over (nothing to
write back to); a null change number is older than any other; an empty batch writes an empty version; a batch run
again gives the same table, counts and quarantine.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hygeia.operators.buckets import KeyedTable, digest_of_ties
from hygeia.plans import rules as R
from hygeia.plans import validate as V
from hygeia.session import discard, materialize, measured

KINDS = ("insert", "replace", "update")  # fixed values
#: Known changes on disk, unless the session names a provider: state in memory grows with every change ever seen.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
         "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}  # a second look-up for each change
COUNTS = "path string, n bigint, bad bigint"
CountsFor = Callable[[list[str]], dict[str, tuple[int, int]]]


def verdict_fields(rules: R.RuleSet, executions: DataFrame, doc: Column) -> T.StructType:
    """The columns ``isValid``, ``invalidPayload``, ``fieldStatus``, ``validated``, ``validatedAt`` of an executions table."""
    out = V.validate(rules, executions.limit(0), doc).select("invalidPayload", "isValid", "fieldStatus").schema
    return T.StructType([*out.fields, T.StructField("validated", T.BooleanType()), T.StructField("validatedAt", T.StringType())])


def executions_table(spark: SparkSession, path: str, documents: T.StructType, verdicts: T.StructType,
                     buckets: int = 200) -> KeyedTable:
    """The executions (exec_id, change_no, doc and further columns of the changes) with their verdicts."""
    return KeyedTable(spark, path, T.StructType([*documents.fields, *verdicts.fields]), ["exec_id"], "change_no", buckets)


def pending(changes: DataFrame, poll: bool = False) -> DataFrame:
    """Changes to validate: of the three kinds, with an id and without ``validated``; with ``poll`` without ``isValid`` too."""
    keep = F.col("op").isin(*KINDS) & F.col("exec_id").isNotNull() & F.col("validated").isNull()
    return changes.where(keep & F.col("isValid").isNull() if poll else keep)


class TypeCounts:
    """Kept counts of non-empty and not-integer values per path, as one small table per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, counts: dict[str, tuple[int, int]], name: str) -> None:
        rows = [(p, n, bad) for p, (n, bad) in sorted(counts.items())]
        self.spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def total(self, batch_id: int) -> dict[str, tuple[int, int]]:
        """Counts after all batches before ``batch_id``: the running totals that the batch before it wrote."""
        if batch_id == 0:
            return {}
        return {r["path"]: (r["n"], r["bad"])
                for r in self.spark.read.schema(COUNTS).parquet(f"{self.path}/batch_id={batch_id - 1}").collect()}

    def add(self, batch_id: int, fresh: DataFrame, replaced: DataFrame, table: DataFrame, doc: Column, paths: list[str]):
        """Counts with a batch: what was kept, plus its rows, less the rows they replace. ``table``: the executions before it."""
        before = self.total(batch_id)
        unknown = [p for p in paths if p not in before]
        if unknown and batch_id:
            before |= R.type_counts(table, doc, unknown)
        known = list(dict.fromkeys([*before, *paths]))
        plus, minus = R.type_counts(fresh, doc, known), R.type_counts(replaced, doc, known)
        now = {}
        for p in known:
            (n, bad), (pn, pbad), (mn, mbad) = (c.get(p, (0, 0)) for c in (before, plus, minus))
            now[p] = (n + pn - mn, bad + pbad - mbad)
        self._write(now, f"batch_id={batch_id}")
        return now


def change_batch(table: KeyedTable, doc: Column, root: str, as_of: str, rules: R.RuleSet | None = None,
                 rules_for: Callable[[CountsFor], R.RuleSet] | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does; ``rules_for(counts_for)`` gives the rules anew for each batch, ``rules`` is fixed."""
    if (rules is None) == (rules_for is None):
        raise ValueError("give either rules or rules_for")
    columns = [n for n in table.schema.names if n not in ("invalidPayload", "isValid", "fieldStatus", "validated", "validatedAt")]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = materialize(batch.withColumn("_bad", doc.isNull()), "changes")  # read several times below
        parsed.where("_bad").drop("_bad").write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")
        last = Window.partitionBy("exec_id").orderBy(F.col("change_no").desc_nulls_last(), "_tie")
        rows = parsed.where(~F.col("_bad")).select(*columns).repartition("exec_id")  # once for both windows
        good = materialize(digest_of_ties(rows, ["exec_id", "change_no"], ["doc"]).withColumn("_r", F.row_number().over(last))
                           .where("_r = 1").select(*columns), "last_changes")
        # with fixed rules nobody reads the documents that are replaced
        stored = materialize(table.stored(good, before=batch_id).select(*(["exec_id", "change_no"] if rules is not None else columns)), "stored")
        known = stored.select("exec_id", F.col("change_no").alias("_known"), F.lit(True).alias("_is"))
        newer = F.col("_is").isNull() | F.coalesce(F.col("change_no") > F.col("_known"),
                                                    F.col("change_no").isNotNull() & F.col("_known").isNull())
        fresh = materialize(good.join(measured(known), "exec_id", "left").where(newer).select(*columns), "fresh")
        if rules is not None:
            now = rules
        else:
            replaced = stored.join(fresh.select("exec_id"), "exec_id", "left_semi")
            before = table.read(batch_id - 1) if batch_id else fresh.limit(0)
            counts = TypeCounts(spark, f"{root}/counts")
            now = rules_for(lambda paths: counts.add(batch_id, fresh, replaced, before, doc, paths))
        out = V.validate(now, fresh, doc)
        table.merge(out.select(*columns, "invalidPayload", "isValid", "fieldStatus", F.lit(True).alias("validated"),
                               F.lit(as_of).alias("validatedAt")), batch_id)
        discard(parsed, good, stored, fresh)  # a stream goes on for ever
    return run


def start(changes: DataFrame, table: KeyedTable, doc: Column, root: str, as_of: str, rules: R.RuleSet | None = None,
          rules_for: Callable[[CountsFor], R.RuleSet] | None = None, poll: bool = False, available_now: bool = True,
          processing_time: str = "10 seconds"):
    """Start the stream. ``changes`` is a streaming DataFrame; the state store grows by a few bytes a change, on disk (``STATE``)."""
    seen_once = pending(changes, poll).dropDuplicates(["exec_id", "change_no"])
    w = (seen_once.writeStream.foreachBatch(change_batch(table, doc, root, as_of, rules, rules_for))
         .option("checkpointLocation", f"{root}/checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    conf = changes.sparkSession.conf
    unset = {k: v for k, v in STATE.items() if conf.get(k, None) is None}
    for k, v in unset.items():
        conf.set(k, v)
    try:
        return w.start()  # which takes the settings with it
    finally:
        for k in unset:
            conf.unset(k)


def append_drafts(table: KeyedTable, drafts: DataFrame, version: int) -> list[int]:
    """Drafted records into a masterlist table keyed by ``ml_id``; a record that is there, or a replay, adds nothing."""
    return table.merge(drafts, version)
