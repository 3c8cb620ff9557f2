"""Review snapshots: upsert for invalid executions, auto-accept for valid ones.

Snapshots are a table keyed by ``execution_id``; the new table is produced
by one keyed upsert (a left join with the previous snapshots, an anti join for the untouched ones and a
union) instead of per-document lookups and writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.plans import suggest as SG
from hygeia.session import materialize, measured

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
PROTECTED = ["ACCEPTED", "REJECTED", "ON HOLD"]
SUG_T = "struct<rank:int,suggestion:string,score:double,overall_score:double,status:string,ml_id:string>"
HIST_T = ("struct<updatedOn:string,updatedBy:string,`from`:array<string>,`to`:array<string>,"
          "valueField:array<string>,source:array<string>>")
META_T = (f"struct<name:string,value:string,validation_status:string,mapping:string,"
          f"comparingData:array<{SUG_T}>>")
ITEM_T = (f"struct<field:string,currentStatus:string,value:string,validation_status:string,mapping:string,"
          f"comparingData:array<{SUG_T}>,metadata:array<{META_T}>>")
DATA_T = (f"struct<invalidFields:array<string>,standardization_status:string,reason:string,"
          f"invalidValues:array<{ITEM_T}>,history:{HIST_T},lastModifiedOn:string>")
SLIM_T = ("array<struct<field:string,currentStatus:string,value:string,saved:array<struct<suggestion:string,status:string>>,"
          "metas:array<struct<name:string,value:string>>>>")
SNAPSHOT_SCHEMA = (f"snapshot_id string, execution_id string, benchmark_type string, benchmark_category string, "
                   f"data array<{DATA_T}>")


def new_history(as_of: str, updated_by: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(F.lit(as_of).alias("updatedOn"), F.lit(updated_by).alias("updatedBy"),
                    empty.alias("from"), empty.alias("to"), empty.alias("valueField"), empty.alias("source"))


def snapshot_id_for(exec_id: Column) -> Column:
    """Deterministic id for a new snapshot (deviation D11: replaces a random uuid)."""
    return F.sha2(F.concat(F.lit("snap:"), exec_id.cast("string")), 256)


def latest(snapshots: DataFrame) -> DataFrame:
    """J5 input: the first snapshot per execution and its first data element."""
    return (snapshots.groupBy("execution_id")
            .agg(F.min_by(F.struct("snapshot_id", "benchmark_type", "benchmark_category", "data"), F.col("snapshot_id")).alias("s"))
            .select("execution_id", F.col("s.snapshot_id").alias("prev_id"), F.get(F.col("s.data"), 0).alias("prev"),
                    F.col("s.benchmark_type").alias("prev_type"), F.col("s.benchmark_category").alias("prev_category"),
                    F.slice("s.data", 2, F.greatest(F.size("s.data") - 1, F.lit(0))).alias("prev_rest")))


def invalid_values(items: DataFrame, validated: DataFrame, id_col: str = "exec_id") -> DataFrame:
    """Nested invalidValues per execution from the X3 long form.

    One aggregation per execution collects its suggestion rows; the nested
    items are then built in-row from the payload with ``transform``/``filter``.
    """
    sugs = (items.groupBy(id_col)
            .agg(F.collect_list(F.struct("field_pos", "item_pos", F.col("rank").cast("int").alias("rank"),
                                         "suggestion", "score", "overall_score", "status", "ml_id")).alias("_sugs")))

    def cd(fp: Column, ip) -> Column:
        sel = F.filter(F.col("_sugs"), lambda x: (x["field_pos"] == fp) & (x["item_pos"] == ip))
        return F.array_sort(F.transform(sel, lambda x: F.struct(
            x["rank"].alias("rank"), x["suggestion"].alias("suggestion"), x["score"].alias("score"),
            x["overall_score"].alias("overall_score"), x["status"].alias("status"), x["ml_id"].alias("ml_id"))))

    def item(e: Column, fp: Column) -> Column:
        return F.struct(
            e["field"].alias("field"), F.lit("invalid").alias("currentStatus"), e["value"].alias("value"),
            e["validation_status"].alias("validation_status"), e["mapping"].alias("mapping"),
            cd(fp, F.lit(-1)).alias("comparingData"),
            F.transform(e["metadata"], lambda m, i: F.struct(
                m["name"].alias("name"), m["value"].alias("value"),
                m["validation_status"].alias("validation_status"), m["mapping"].alias("mapping"),
                cd(fp, i).alias("comparingData"))).alias("metadata"))

    v = validated.select(id_col, "invalidPayload").join(sugs, id_col, "left").withColumn(
        "_sugs", F.coalesce("_sugs", F.array().cast(
            f"array<struct<field_pos:int,item_pos:int,rank:int,suggestion:string,score:double,"
            f"overall_score:double,status:string,ml_id:string>>")))
    return v.select(id_col, F.transform("invalidPayload", lambda e, fp: item(e, fp)).alias("invalidValues"))


def upsert_snapshots(previous: DataFrame, validated: DataFrame, items: DataFrame, as_of: str,
                     updated_by: str = "system", id_col: str = "exec_id") -> DataFrame:
    """X1 + X2 as one keyed upsert; returns the complete new snapshot table.

    invalid execution -> snapshot replaced (id, upper-cased status and history kept;
                         values and suggestions recomputed; reason dropped)
    valid execution   -> existing snapshot not ACCEPTED / REJECTED / ON HOLD becomes ACCEPTED, with a stamp; its type,
                         category and later data elements stay
    anything else     -> unchanged
    """
    prev = latest(previous)
    # every join has the text id for its key, so that the nested items are shuffled once
    by_text = F.col(id_col).cast("string")
    inv = invalid_values(items.withColumn(id_col, by_text), validated.where(~F.col("isValid")).withColumn(id_col, by_text), id_col)
    cur = validated.select(by_text.alias("execution_id"), "isValid", "invalid_names", F.col("benchmarkType").alias("benchmark_type"),
                           F.col("benchmarkCategory").alias("benchmark_category"))
    j = cur.join(inv.withColumnRenamed(id_col, "execution_id"), "execution_id", "left").join(prev, "execution_id", "left")
    prev_status = F.col("prev.standardization_status")
    status_inv = F.when(F.coalesce(prev_status, F.lit("")) != "", F.upper(prev_status)).otherwise(F.lit("PENDING"))
    new_doc = F.struct(
        F.col("invalid_names").alias("invalidFields"), status_inv.alias("standardization_status"),
        F.lit(None).cast("string").alias("reason"),
        F.coalesce("invalidValues", F.array().cast(f"array<{ITEM_T}>")).alias("invalidValues"),
        F.coalesce(F.col("prev.history"), new_history(as_of, updated_by)).alias("history"),
        F.lit(None).cast("string").alias("lastModifiedOn"))
    accept = F.col("prev").isNotNull() & ~F.upper(F.coalesce(prev_status, F.lit(""))).isin(*PROTECTED)
    accepted_doc = (F.col("prev").withField("standardization_status", F.lit("ACCEPTED"))
                    .withField("lastModifiedOn", F.lit(as_of)))
    touched = j.where(~F.col("isValid") | accept).select(
        F.coalesce("prev_id", snapshot_id_for(F.col("execution_id"))).alias("snapshot_id"),
        "execution_id", *[F.when(F.col("isValid"), F.col(f"prev_{c}")).otherwise(F.col(f"benchmark_{c}")).alias(f"benchmark_{c}")
                          for c in ("type", "category")],
        F.when(~F.col("isValid"), F.array(new_doc)).otherwise(F.concat(F.array(accepted_doc), "prev_rest")).alias("data"))
    # untouched previous snapshots keep every column as it was; which are touched is found without items and histories
    d0 = F.get(F.col("data"), 0)
    slim = (previous.groupBy("execution_id")
            .agg(F.min_by(F.struct("snapshot_id", F.when(d0.isNotNull(), F.struct(d0["standardization_status"].alias(
                "standardization_status"))).alias("prev")), F.col("snapshot_id")).alias("s"))
            .select("execution_id", F.col("s.snapshot_id").alias("prev_id"), F.col("s.prev").alias("prev")))
    ids = (cur.select("execution_id", "isValid").join(slim, "execution_id", "left").where(~F.col("isValid") | accept)
           .select(F.coalesce("prev_id", snapshot_id_for(F.col("execution_id"))).alias("_sid")))
    kept = previous.join(ids, previous["snapshot_id"] == F.col("_sid"), "left_anti")
    return kept.unionByName(touched.select(*previous.columns))


def seed_snapshots(seed: DataFrame) -> DataFrame:
    """Flat seed (exec_id, snapshot_id, status, updated_on) -> snapshot table schema."""
    empty = F.array().cast("array<string>")
    d = F.struct(empty.alias("invalidFields"), F.col("status").alias("standardization_status"),
                 F.lit(None).cast("string").alias("reason"), F.array().cast(f"array<{ITEM_T}>").alias("invalidValues"),
                 F.struct(F.col("updated_on").alias("updatedOn"), F.lit("seed").alias("updatedBy"),
                          empty.alias("from"), empty.alias("to"), empty.alias("valueField"),
                          empty.alias("source")).alias("history"),
                 F.lit(None).cast("string").alias("lastModifiedOn"))
    return seed.select("snapshot_id", F.col("exec_id").cast("string").alias("execution_id"),
                       F.lit(None).cast("string").alias("benchmark_type"),
                       F.lit(None).cast("string").alias("benchmark_category"), F.array(d).alias("data"))


def snapshot_flat(snaps: DataFrame) -> DataFrame:
    d = F.get(F.col("data"), 0)
    return snaps.select(
        "execution_id", "snapshot_id", d["standardization_status"].alias("status"),
        F.array_join(d["invalidFields"], ",").alias("invalid_fields"),
        F.size(d["invalidValues"]).cast("bigint").alias("n_invalid_values"),
        F.aggregate(d["invalidValues"], F.lit(0).cast("bigint"),
                    lambda acc, it: acc + F.size(it["comparingData"])
                    + F.aggregate(it["metadata"], F.lit(0).cast("bigint"),
                                  lambda a2, m: a2 + F.size(m["comparingData"]))).alias("n_comparing"),
        d["history"]["updatedOn"].alias("history_updated_on"), d["lastModifiedOn"].alias("last_modified_on"))


def snapshot_detail(rules, snapshots: DataFrame, validated: DataFrame | None = None, n: int = 3,
                    id_col: str = "exec_id") -> DataFrame:
    """X4/R6 (batch form of the live detail view) with J17 and the read-time X2.

    For every stored invalid item: suggestions are recomputed from the item's own value and
    metadata (J9); each keeps the status saved on the first stored suggestion with the same
    value, else PENDING (J17); field scores use ``ratio``; metadata rows follow the suggested
    record's metadata.  ``status`` is the snapshot status, ACCEPTED when the execution is now
    valid and the stored status is not protected (X2, read-time variant).
    Long form: (execution_id, field_pos, invalid_field, current_status, snapshot_status, item,
    name, rank, suggestion, score, overall_score, status).
    """
    from hygeia.functions import fuzzy as FZ
    from hygeia.functions import text as T
    from hygeia.operators.knn import knn_join
    d0 = F.get(F.col("data"), 0)
    # of an item only what is read below goes on: the stored suggestions of its metadata, most of its bytes, are recomputed
    slim = F.transform(d0["invalidValues"], lambda it: F.struct(
        it["field"].alias("field"), it["currentStatus"].alias("currentStatus"), it["value"].alias("value"),
        F.transform(it["comparingData"], lambda s: F.struct(s["suggestion"].alias("suggestion"), s["status"].alias("status"))).alias("saved"),
        F.transform(it["metadata"], lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value"))).alias("metas")))
    none = F.array().cast(SLIM_T)
    # a snapshot without items has no rows, so it needn't meet its execution
    snap = (snapshots.select("execution_id", d0["standardization_status"].alias("_st"), F.coalesce(slim.cast(SLIM_T), none).alias("_items"))
            .where(F.size("_items") > 0))
    if validated is not None:
        live = validated.select(F.col(id_col).cast("string").alias("execution_id"), F.col("isValid").alias("_live"))
        snap = snap.join(measured(live), "execution_id", "left")
        st = F.when(F.coalesce("_live", F.lit(False)) & ~F.upper(F.coalesce("_st", F.lit(""))).isin(*PROTECTED),
                    F.lit("ACCEPTED")).otherwise(F.col("_st"))
    else:
        st = F.col("_st")
    items = snap.select("execution_id", st.alias("snapshot_status"), F.posexplode("_items").alias("field_pos", "it"))
    metas = F.array_sort(F.col("it.metas"))
    parts = F.concat(F.array(T.py_strip(F.col("it.value"))),
                     F.transform(F.filter(metas, lambda m: T.py_strip(m["value"]) != ""), lambda m: T.py_strip(m["value"])))
    e = items.select("execution_id", "snapshot_status", "field_pos", F.col("it.field").alias("invalid_field"),
                     F.col("it.currentStatus").alias("current_status"), F.col("it.value").alias("value"),
                     F.map_from_entries(metas).alias("actual"), F.col("it.saved").alias("saved"),
                     T.signature(parts).alias("qsig"))
    e = materialize(e, "detail_items")  # read by the neighbours, the pairs to score and the result
    sigs = rules.signatures
    nn = knn_join(e.select(F.col("invalid_field").alias("field"), "qsig"), sigs, group="field", q_text="qsig",
                  doc_id="ordinal", d_text="signature", order="ordinal", n=n)
    nn = nn.join(sigs.select("field", "ordinal", "primary_value", F.col("metadata").alias("sug_meta")),
                 ["field", "ordinal"]).withColumnRenamed("field", "invalid_field")
    # written, measured and broadcast when small: items of a frequent signature then stay where they are
    j = e.join(measured(materialize(nn, "neighbours")), ["invalid_field", "qsig"])
    saved = F.get(F.filter(F.coalesce("saved", F.array().cast("array<struct<suggestion:string,status:string>>")),
                           lambda s: s["suggestion"] == F.col("primary_value")), 0)["status"]
    j = j.withColumn("status", F.coalesce(saved, F.lit("PENDING")))
    base = ["execution_id", "field_pos", "invalid_field", "current_status", "snapshot_status", "rank",
            F.col("score").alias("overall_score"), "status"]
    prim = j.select(*base, F.lit("primary").alias("item"), F.col("invalid_field").alias("name"),
                    F.col("primary_value").alias("suggestion"), F.lower("value").alias("_a"),
                    F.lower("primary_value").alias("_b"))
    meta = j.select(*base, "actual", F.explode("sug_meta").alias("name", "suggestion")).select(
        "*", F.lit("metadata").alias("item"))
    meta = meta.select(
        *[c for c in ["execution_id", "field_pos", "invalid_field", "current_status", "snapshot_status", "rank",
                      "overall_score", "status", "item", "name", "suggestion"]],
        F.lower(F.coalesce(F.col("actual")[F.col("name")], F.lit(""))).alias("_a"),
        F.lower(F.col("suggestion")).alias("_b"))
    rows = FZ.with_ratio(prim.unionByName(meta), "_a", "_b", "score")
    return rows.select("execution_id", "field_pos", "invalid_field", "current_status", "snapshot_status", "item",
                       "name", "rank", "suggestion", "score", "overall_score", "status")
