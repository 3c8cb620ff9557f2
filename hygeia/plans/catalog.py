"""Registered queries: name -> (spark, sf_dir) -> flat DataFrame.

Outputs are flat (no arrays / maps) so they compare value-for-value with the
DuckDB oracle; scores are rounded half-even to 4 decimals.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygeia.plans import validate as V
from hygeia.plans.context import run_for
from hygeia.plans import reports as RP
from hygeia.session import materialize, shuffle_cleanup


def q_rule_mappings(spark: SparkSession, sf: str) -> DataFrame:
    r = run_for(spark, sf).rules
    rows = [(m.field, m.path, m.resolved, m.primary, r.types[m.field]) for m in r.mappings]
    return spark.createDataFrame(rows, "field string, path string, resolved_path string, "
                                       "is_primary boolean, field_type string")


def q_rule_configs(spark: SparkSession, sf: str) -> DataFrame:
    r = run_for(spark, sf).rules
    return (r.records.where(F.col("value") != "")
            .select("field", "value", "ordinal", "ml_id", F.posexplode("reqs").alias("req_pos", "q"))
            .select("field", "value", "ordinal", "ml_id", "req_pos", F.col("q.name").alias("name"),
                    F.col("q.path").alias("path"), F.col("q.required").alias("required")))


def q_rule_signatures(spark: SparkSession, sf: str) -> DataFrame:
    r = run_for(spark, sf).rules
    return r.signatures.select("field", "ordinal", "ml_id", "primary_value", "signature")


def q_valid_values(spark: SparkSession, sf: str) -> DataFrame:
    r = run_for(spark, sf).rules
    return r.values.select("field", "value", "ml_id")


def q_field_values(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return V.field_values(run.rules, run.executions, run.doc)


def q_primary_status(spark: SparkSession, sf: str) -> DataFrame:
    return V.primary_status(run_for(spark, sf).validated)


def q_best_config(spark: SparkSession, sf: str) -> DataFrame:
    return (V.primary_status(run_for(spark, sf).validated)
            .where(F.col("best_ml_id").isNotNull())
            .select("exec_id", "field", "best_ml_id", "best_ordinal", "best_errors"))


def q_invalid_values_anti(spark: SparkSession, sf: str) -> DataFrame:
    """J1 as an anti-join: applicable, non-empty primary values outside the valid set."""
    run = run_for(spark, sf)
    ps = V.primary_status(run.validated).where(F.col("applicable") & ~F.col("empty"))
    return (ps.join(run.rules.values.select("field", "value"), ["field", "value"], "left_anti")
            .select("exec_id", "field", "value"))


def q_invalid_payload_flat(spark: SparkSession, sf: str) -> DataFrame:
    return V.payload_flat(run_for(spark, sf).validated)


def q_document_verdict(spark: SparkSession, sf: str) -> DataFrame:
    v = run_for(spark, sf).validated
    return v.select("exec_id", F.col("isValid").alias("is_valid"),
                    F.size("invalidPayload").cast("bigint").alias("n_invalid_fields"),
                    F.array_join("invalid_names", ",").alias("invalid_names"))


def q_invalid_names(spark: SparkSession, sf: str) -> DataFrame:
    v = run_for(spark, sf).validated
    return v.select("exec_id", F.explode("invalid_names").alias("name"))


def q_validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return RP.validation_counts(run.validated, [m.field for m in run.rules.mappings])


def q_validity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return V.totals(run_for(spark, sf).validated)


QUERIES = {
    "rule_mappings": q_rule_mappings,
    "rule_configs": q_rule_configs,
    "rule_signatures": q_rule_signatures,
    "valid_values": q_valid_values,
    "field_values": q_field_values,
    "primary_status": q_primary_status,
    "best_config": q_best_config,
    "invalid_values_anti": q_invalid_values_anti,
    "invalid_payload_flat": q_invalid_payload_flat,
    "document_verdict": q_document_verdict,
    "invalid_names": q_invalid_names,
    "validation_counts": q_validation_counts,
    "validity_totals": q_validity_totals,
}


# --- suggestions -----------------------------------------------------------
from hygeia.plans import suggest as SG  # noqa: E402


def _record_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    if "rec_sug" not in run.__dict__:
        run.__dict__["rec_sug"] = materialize(SG.record_suggestions(run.rules, run.validated), "rec_sug")
    return run.__dict__["rec_sug"]


def q_suggest_record_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _record_suggestions(spark, sf).select("exec_id", "field", "rank", "ml_id", "primary_value",
                                                 "overall_score")


def q_snapshot_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return SG.suggestion_items(_record_suggestions(spark, sf)).drop("field_pos", "item_pos")


def q_suggest_field_knn(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    ps = V.primary_status(run.validated).where((F.col("status") == "invalid") & ~F.col("empty"))
    return SG.field_suggestions(run.rules, ps.select("field", "value"))


QUERIES.update({
    "suggest_record_knn": q_suggest_record_knn,
    "snapshot_suggestions": q_snapshot_suggestions,
    "suggest_field_knn": q_suggest_field_knn,
})


# --- snapshots -------------------------------------------------------------
from hygeia.plans import snapshot as SN  # noqa: E402
from hygeia.sources import fixtures as FX  # noqa: E402

AS_OF = "2001-08-10T00:00:00.000000Z"


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    if "snaps" not in run.__dict__:
        prev = SN.seed_snapshots(FX.snapshot_seed(spark, run.sf_dir))
        items = SG.suggestion_items(_record_suggestions(spark, sf))
        run.__dict__["snaps"] = materialize(
            SN.upsert_snapshots(prev, run.validated, items, AS_OF, "hygiene-batch"), "snapshots")
    return run.__dict__["snaps"]


def q_snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return SN.snapshot_flat(_snapshots(spark, sf))


def q_auto_accept(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    prev = FX.snapshot_seed(spark, run.sf_dir).select(F.col("exec_id").cast("string").alias("execution_id"),
                                                      F.col("status").alias("old_status"))
    new = SN.snapshot_flat(_snapshots(spark, sf)).select("execution_id", "snapshot_id",
                                                        F.col("status").alias("new_status"), "last_modified_on")
    valid = run.validated.where("isValid").select(F.col("exec_id").cast("string").alias("execution_id"))
    return valid.join(prev, "execution_id").join(new, "execution_id")


QUERIES.update({
    "snapshot_upsert": q_snapshot_upsert,
    "auto_accept": q_auto_accept,
})


# --- reports ---------------------------------------------------------------
AS_OF_TS = "2001-08-10 00:00:00"


def q_ageing_pending(spark: SparkSession, sf: str) -> DataFrame:
    return RP.ageing_pending(SN.seed_snapshots(FX.snapshot_seed(spark, sf)), AS_OF_TS)


def q_ageing_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return RP.ageing_filtered(SN.seed_snapshots(FX.snapshot_seed(spark, sf)), AS_OF_TS)


def q_invalid_records_page(spark: SparkSession, sf: str) -> DataFrame:
    return RP.invalid_records_page(run_for(spark, sf).validated, "PENDING", None, 1, 50)


def q_invalid_records_late_page(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    if "record_index" not in run.__dict__:
        run.__dict__["record_index"] = RP.invalid_records_index(run.validated, rows_per_range=2_000)
    return RP.invalid_records_at(run.record_index, 41, 50)


def q_invalid_records_search(spark: SparkSession, sf: str) -> DataFrame:
    return RP.invalid_records_page(run_for(spark, sf).validated, "PENDING", "urgent", 2, 20)


def q_invalid_summary(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return RP.invalid_summary(_snapshots(spark, sf), run.executions, None, None, 1, 50)


def q_unique_values(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return RP.unique_values(run.masterlist, [m.field for m in run.rules.mappings])


def q_parameter_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values of every parameter that has a common name."""
    run = run_for(spark, sf)
    mapped = [m.field for m in run.rules.mappings]
    types = [m.field for m in run.rules.mappings if m.primary]
    parts = [RP.parameter_values(run.masterlist, p, mapped, types) for p in RP.PARAMETERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_metadata_values(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    req = (run.masterlist.where("status = 'Published'")
           .select(F.col("type").alias("req_type"), F.col("data.value").alias("req_value")).distinct())
    return RP.metadata_values(run.masterlist, req)


QUERIES.update({
    "ageing_pending": q_ageing_pending,
    "ageing_filtered": q_ageing_filtered,
    "invalid_records_page": q_invalid_records_page,
    "invalid_records_late_page": q_invalid_records_late_page,
    "invalid_records_search": q_invalid_records_search,
    "invalid_summary": q_invalid_summary,
    "unique_values": q_unique_values,
    "metadata_values": q_metadata_values,
    "parameter_values": q_parameter_values,
})


# --- streaming -------------------------------------------------------------
import uuid  # noqa: E402

from hygeia.session import checkpoint_dir  # noqa: E402
from hygeia.streaming import validate_stream as ST  # noqa: E402


def q_stream_validate(spark: SparkSession, sf: str) -> DataFrame:
    """ST1/ST2: the execution table lands as several files in a fresh folder under the shared
    checkpoint directory, is validated by an AvailableNow stream, and the verdicts are read back."""
    run = run_for(spark, sf)
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src, sink, ckpt = f"{root}/source", f"{root}/sink", f"{root}/checkpoint"
    run.executions.write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = ST.start(spark, stream, run.rules, F.col("doc"), sink, ckpt, AS_OF)
    q.awaitTermination()
    v = ST.latest_verdicts(spark, sink)
    return v.select("exec_id", F.col("isValid").alias("is_valid"),
                    F.size("invalidPayload").cast("bigint").alias("n_invalid_fields"),
                    F.array_join("invalid_names", ",").alias("invalid_names"))


QUERIES["stream_validate"] = q_stream_validate


# --- changes of documents --------------------------------------------------
from hygeia.streaming import change_stream as CS  # noqa: E402


def _changes(executions: DataFrame) -> DataFrame:
    """Changes: an insert of each execution (every third delivered twice, every eleventh validated before), an update of some
    with the document of the next, and changes of another kind."""
    k = F.col("exec_id")
    none = F.lit(None).cast("boolean")

    def change(rows: DataFrame, id_col, no: int, op, validated) -> DataFrame:
        return rows.select(id_col.alias("exec_id"), F.lit(no).cast("bigint").alias("change_no"), op.alias("op"), "doc",
                           none.alias("isValid"), validated.alias("validated"))

    inserts = change(executions, k, 1, F.lit("insert"), F.when(k % 11 == 5, F.lit(True)))
    again = change(executions.where(k % 3 == 0), k, 1, F.lit("insert"), F.when(k % 11 == 5, F.lit(True)))
    updates = change(executions.where(k % 7 == 1), k - 1, 2, F.when(k % 2 == 0, F.lit("update")).otherwise(F.lit("replace")), none)
    other = change(executions.where(k % 13 == 0), k, 3, F.lit("delete"), none)
    return inserts.unionByName(again).unionByName(updates).unionByName(other)


def q_stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """S7-S10, ST1, ST3: the executions with their verdicts after a stream of changes in several micro-batches."""
    run = run_for(spark, sf)
    root = f"{checkpoint_dir(spark).rstrip('/')}/changes-{uuid.uuid4().hex}"
    # as many tasks write as there are partitions, whatever the number of files a micro-batch takes: two batches, as half of them each
    half = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    with shuffle_cleanup(spark):
        _changes(run.executions).repartition(2 * half).write.parquet(f"{root}/source")
    source = spark.read.parquet(f"{root}/source")
    verdicts = CS.verdict_fields(run.rules, source, F.col("doc"))
    table = CS.executions_table(spark, f"{root}/executions", source.select("exec_id", "change_no", "doc").schema, verdicts, 16)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", half).parquet(f"{root}/source")
    CS.start(stream, table, F.col("doc"), root, AS_OF, rules=run.rules).awaitTermination()
    return table.read().select("exec_id", "change_no", F.col("isValid").alias("is_valid"),
                               F.size("invalidPayload").cast("bigint").alias("n_invalid_fields"), "validated",
                               F.col("validatedAt").alias("validated_at"))


QUERIES["stream_changes"] = q_stream_changes


# --- decisions -------------------------------------------------------------
from hygeia.plans import decisions as DC  # noqa: E402


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision table: an approval decides one of its snapshot's invalid items (by decision id), or with a click the
    item's first metadata name."""
    run = run_for(spark, sf)
    if "decisions" not in run.__dict__:
        ev = FX.decision_events(spark, run.sf_dir)
        d0 = F.get(F.col("data"), 0)
        # of an item only what a decision can name is joined
        first = lambda c: F.get(c, 0)
        items = _snapshots(spark, sf).select("execution_id", F.transform(d0["invalidValues"], lambda it: F.struct(
            it["field"].alias("field"), first(it["comparingData"])["suggestion"].alias("suggestion"),
            first(it["metadata"])["name"].alias("meta_name"),
            first(first(it["metadata"])["comparingData"])["suggestion"].alias("meta_suggestion"))).alias("_items"))
        j = ev.join(items, "execution_id", "left").withColumn("_it", F.get(
            F.col("_items"), (F.col("decision_id") % F.greatest(F.size("_items"), F.lit(1))).cast("int")))
        click = F.col("event_type") == "click"
        d = j.select(
            "decision_id", "ts", "kind", "execution_id",
            F.when(F.col("kind") == "approve", F.when(click, F.col("_it.meta_name")).otherwise(F.col("_it.field"))).alias("field_name"),
            F.when(F.col("event_type") == "purchase", F.col("_it.suggestion"))
            .when(click, F.coalesce("_it.meta_suggestion", F.lit("manual")))
            .when(F.col("event_type") == "view", F.concat(F.lit("custom-"), F.col("execution_id")))
            .alias("accepted_value"),
            F.lit(None).cast("int").alias("rank"),
            F.when(F.col("kind") == "reject", F.lit("Rejected"))
            .when(F.col("kind") == "approve", F.lit("Approved")).alias("current_status"),
            F.lit(None).cast("string").alias("core_count"), "type", "value", "metadata")
        run.__dict__["decisions"] = materialize(d, "decisions")
    return run.__dict__["decisions"]


def _joined(c: str, sep: str = "|") -> "F.Column":
    return F.array_join(F.transform(F.get(F.col("data"), 0)["history"][c], lambda x: F.coalesce(x, F.lit(""))), sep)


def q_apply_rejections(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = DC.apply_rejections(_snapshots(spark, sf), _decisions(spark, sf), AS_OF, "reviewer")
    d0 = F.get(F.col("data"), 0)
    return out.select("execution_id", d0["standardization_status"].alias("status"), d0["reason"].alias("reason"),
                      _joined("valueField", ",").alias("history_fields"), _joined("from").alias("history_from"),
                      F.size(d0["invalidValues"]).cast("bigint").alias("n_items"))


def _approvals(spark: SparkSession, sf: str):
    run = run_for(spark, sf)
    if "approvals" not in run.__dict__:
        run.__dict__["approvals"] = DC.apply_approvals(_snapshots(spark, sf), _decisions(spark, sf), run.masterlist, AS_OF,
                                                       "reviewer")
    return run.__dict__["approvals"]


def q_apply_approvals(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _approvals(spark, sf)
    d0 = F.get(F.col("data"), 0)
    return out.select("execution_id", d0["standardization_status"].alias("status"),
                      _joined("valueField", ",").alias("history_fields"), _joined("to").alias("history_to"),
                      _joined("source", ",").alias("history_source"))


def q_execution_updates(spark: SparkSession, sf: str) -> DataFrame:
    _, a = _approvals(spark, sf)
    _, r = DC.apply_rejections(_snapshots(spark, sf), _decisions(spark, sf), AS_OF, "reviewer")
    return a.drop("seq").unionByName(r)


def q_history_changes(spark: SparkSession, sf: str) -> DataFrame:
    return DC.history_changes(_approvals(spark, sf)[0])


def _drafted(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return DC.draft_records(run.masterlist, _decisions(spark, sf), AS_OF)


def q_draft_new(spark: SparkSession, sf: str) -> DataFrame:
    return _drafted(spark, sf).select("ordinal", "type", "status", F.col("data.value").alias("value"),
                                      F.col("data.metadata")["Family"].alias("family"))


def q_draft_hold(spark: SparkSession, sf: str) -> DataFrame:
    held = DC.hold_snapshots(_snapshots(spark, sf), _drafted(spark, sf).withColumn(
        "execution_id", F.lit(None).cast("string")), AS_OF)
    d0 = F.get(F.col("data"), 0)
    return held.select("execution_id", "snapshot_id", d0["standardization_status"].alias("status"))


def q_draft_ids(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return DC.draft_ids(run.masterlist)


QUERIES.update({
    "apply_rejections": q_apply_rejections,
    "apply_approvals": q_apply_approvals,
    "execution_updates": q_execution_updates,
    "history_changes": q_history_changes,
    "draft_new": q_draft_new,
    "draft_hold": q_draft_hold,
    "draft_ids": q_draft_ids,
})


# --- fuzzy (scorer-based) joins --------------------------------------------
def q_suggest_field_partial(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    ps = V.primary_status(run.validated).where((F.col("status") == "invalid") & ~F.col("empty"))
    return SG.field_suggestions_fuzzy(run.rules, ps.select("field", "value"))


def _tokenset(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    if "tokenset" not in run.__dict__:
        run.__dict__["tokenset"] = materialize(SG.record_suggestions_fuzzy(run.rules, run.validated), "tokenset")
    return run.__dict__["tokenset"]


def q_suggest_record_tokenset(spark: SparkSession, sf: str) -> DataFrame:
    return _tokenset(spark, sf)


def q_fuzzy_exists(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return SG.fuzzy_exists(run.rules, run.validated, matches=_tokenset(spark, sf))


def q_resolve_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct observed instanceType text resolved against the published instance types."""
    run = run_for(spark, sf)
    terms = (V.field_values(run.rules, run.executions, run.doc).where(F.col("field") == "instanceType")
             .select(F.col("value").alias("term")).where(F.col("term") != "").distinct())
    return SG.resolve_terms(run.masterlist.where("status = 'Published'"), terms, ["instanceType"], 60)


QUERIES.update({
    "suggest_field_partial": q_suggest_field_partial,
    "suggest_record_tokenset": q_suggest_record_tokenset,
    "fuzzy_exists": q_fuzzy_exists,
    "resolve_terms": q_resolve_terms,
})


# --- search, schema, overlays ----------------------------------------------
from hygeia.operators import upsert as UP  # noqa: E402
from hygeia.plans import rules as RL  # noqa: E402


def q_snapshot_search(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    out = RP.snapshot_search(_snapshots(spark, sf), run.executions, "urgent", 1, 50)
    return out.withColumn("history_updated_on", F.col("history.updatedOn")).drop("history")


def q_metadata_schema(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return RL.metadata_schema(run.masterlist, "cpumodel")


def q_valid_values_and_paths(spark: SparkSession, sf: str) -> DataFrame:
    return RL.valid_values_and_paths(run_for(spark, sf).rules)


def q_apply_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Approved values written back into the execution documents."""
    run = run_for(spark, sf)
    _, upd = _approvals(spark, sf)
    ex = run.executions.select(F.col("exec_id").cast("string").alias("exec_id"), "doc")
    out = UP.apply_document_updates(ex, upd, "doc", "exec_id")
    changed = upd.select("exec_id").distinct()
    return out.join(changed, "exec_id", "left_semi").select(
        "exec_id", F.col("doc.platformProfile.sut.Summary.Server.CPUModel").alias("cpu_model"),
        F.col("doc.platformProfile.sut.Summary.CPU.`CPU(s)`").alias("core_count"),
        F.col("doc.sutInstanceMetadata.instanceType").alias("instance_type"),
        F.col("doc.benchmarkCategory").alias("benchmark_category"), F.col("doc.isValid").alias("is_valid"))


QUERIES.update({
    "snapshot_search": q_snapshot_search,
    "metadata_schema": q_metadata_schema,
    "valid_values_and_paths": q_valid_values_and_paths,
    "apply_updates": q_apply_updates,
})


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    if "reviewed" not in run.__dict__:
        run.__dict__["reviewed"] = materialize(DC.review_snapshots(
            _snapshots(spark, sf), _decisions(spark, sf), run.masterlist, _drafted(spark, sf), AS_OF, "reviewer"), "reviewed")
    return run.__dict__["reviewed"]


def q_reviewed_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The complete snapshot table after a batch of decisions."""
    return SN.snapshot_flat(_reviewed(spark, sf))


QUERIES["reviewed_snapshots"] = q_reviewed_snapshots


def q_snapshot_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Live detail of every stored snapshot (after the review decisions were applied)."""
    run = run_for(spark, sf)
    return SN.snapshot_detail(run.rules, _reviewed(spark, sf), run.validated).drop("field_pos")


QUERIES["snapshot_detail"] = q_snapshot_detail


# --- a snapshot as a reviewer opens it -------------------------------------
from hygeia.plans import detail as DT  # noqa: E402


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    """All snapshots after the rejections of the batch, which write a history."""
    run = run_for(spark, sf)
    if "rejected" not in run.__dict__:
        run.__dict__["rejected"] = materialize(DC.rejected_snapshots(_snapshots(spark, sf), _decisions(spark, sf), AS_OF, "reviewer"),
                                               "rejected_all")
    return run.__dict__["rejected"]


def q_snapshot_headers(spark: SparkSession, sf: str) -> DataFrame:
    run = run_for(spark, sf)
    return DT.headers(_rejected(spark, sf), run.executions, run.doc, run.validated)


def q_snapshot_existing_data(spark: SparkSession, sf: str) -> DataFrame:
    return DT.existing_data(_rejected(spark, sf))


def q_snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    lists = DT.changes_by_field(_rejected(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), "|").alias(f"{c}_values")
    return lists.select("execution_id", "field_pos", "field", text("from"), text("to"))


def q_accept_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """The stored snapshots of executions that pass now, opened before any batch has rewritten them."""
    run = run_for(spark, sf)
    snaps, cleared = DT.accept_on_read(SN.seed_snapshots(FX.snapshot_seed(spark, run.sf_dir)), run.validated)
    new = snaps.select("execution_id", "snapshot_id", F.get(F.col("data"), 0)["standardization_status"].alias("new_status"))
    return (cleared.select(F.col("exec_id").alias("execution_id"), F.col("isValid").alias("is_valid"),
                           F.size("invalidPayload").cast("bigint").alias("n_invalid_fields"),
                           F.col("fieldStatus").isNull().alias("field_status_unset"))
            .join(new, "execution_id", "left"))


def q_draft_hold_by_execution(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts that name their execution hold its snapshot only."""
    held = DC.hold_snapshots(_snapshots(spark, sf), _drafted(spark, sf), AS_OF)
    d0 = F.get(F.col("data"), 0)
    return held.select("execution_id", "snapshot_id", d0["standardization_status"].alias("status"), d0["reason"].alias("reason"),
                       F.size(F.filter(d0["invalidValues"], lambda it: it["currentStatus"] == "ON HOLD")).cast("bigint").alias("n_held"))


QUERIES.update({
    "snapshot_headers": q_snapshot_headers,
    "snapshot_existing_data": q_snapshot_existing_data,
    "snapshot_changes": q_snapshot_changes,
    "accept_on_read": q_accept_on_read,
    "draft_hold_by_execution": q_draft_hold_by_execution,
})


# --- searches by a resolved term, details, ages ------------------------------
TERM = "urgnt"  # a misspelt category: no value matches it as an expression


def q_invalid_records_details(spark: SparkSession, sf: str) -> DataFrame:
    """Payload rows of a page of the records found by a resolved category."""
    run = run_for(spark, sf)
    resolved = RP.resolve_search(run.masterlist, TERM, "benchmarkType", "benchmarkCategory")
    page = RP.invalid_records_page(run.validated, "PENDING", TERM, 2, 50, resolved=resolved)
    rows = RP.payload_details(page, run.validated).select(
        "execution_id", "benchmark_category", "total", F.posexplode("details").alias("field_pos", "e"))
    return rows.select("execution_id", "benchmark_category", "total", "field_pos", F.col("e.field").alias("field"),
                       F.col("e.value").alias("value"), F.col("e.validation_status").alias("validation_status"),
                       F.col("e.mapping").alias("mapping"), F.size("e.metadata").cast("bigint").alias("n_metadata"))


def q_invalid_summary_found(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a search with the counts by age of the same filter."""
    run = run_for(spark, sf)
    resolved = RP.resolve_search(run.masterlist, TERM, "benchmark_type", "benchmark_category")
    return RP.invalid_summary(_snapshots(spark, sf), run.executions, ["pending", "on hold"], TERM, 1, 50,
                              resolved=resolved, as_of=AS_OF_TS)


QUERIES.update({
    "invalid_records_details": q_invalid_records_details,
    "invalid_summary_found": q_invalid_summary_found,
})


# --- free-form documents -----------------------------------------------------
from hygeia.sources import documents as DO  # noqa: E402


def q_masterlist_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The masterlist as JSON records whose id stands under one of three keys."""
    ml = run_for(spark, sf).masterlist
    k, own = F.col("ordinal") % 4, F.col("ml_id")
    oid = F.struct(own.alias("$oid"))
    record = F.to_json(F.struct(
        F.when(k == 0, own).when(k == 1, F.lit("")).alias("`_id`"), F.when(k < 2, own).when(k == 2, F.lit("")).alias("id"),
        F.when(k >= 2, oid).alias("_id"), "type", "status", "data"))
    doc = F.col("doc")
    back = DO.masterlist(ml.select("ordinal", F.try_parse_json(record).alias("doc")), doc, F.col("ordinal"))
    return back.select("ordinal", "ml_id", "type", "status", F.col("data.value").alias("value"),
                       F.size("data.metadata").cast("bigint").alias("n_metadata"))


def q_execution_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of executions given as JSON documents, every fifth without an id of its own."""
    run = run_for(spark, sf)
    own = F.col("exec_id") % 5 != 0
    oid = F.struct(F.concat(F.lit("x"), F.col("exec_id").cast("string")).alias("$oid"))
    text = F.to_json(F.struct(*[F.when(own, F.col(f"doc.{f}")).alias(f) if f == "benchmarkExecutionID" else F.col(f"doc.{f}")
                                for f in run.executions.select("doc.*").columns], F.when(~own, oid).alias("_id")))
    docs = run.executions.select(F.try_parse_json(text).alias("raw"))
    v = V.validate(run.rules, DO.executions(docs, F.col("raw")), F.col("doc"), meta_paths=run.meta_paths)
    return v.select("exec_id", F.col("isValid").alias("is_valid"), F.size("invalidPayload").cast("bigint").alias("n_invalid_fields"),
                    F.array_join("invalid_names", ",").alias("invalid_names"))


QUERIES.update({
    "masterlist_documents": q_masterlist_documents,
    "execution_documents": q_execution_documents,
})
