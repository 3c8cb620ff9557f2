"""Review decisions applied in batches.

The reference applies one decision per request; here a decisions table is
applied to the snapshot table in one pass: the approvals of an execution are
folded over its snapshot in order (``aggregate``), a rejection needs only the latest, and
the nested snapshot is rewritten with higher-order functions
(``transform`` / ``withField``).  Side outputs are update tables
``(exec_id, path, value)`` for the execution documents and masterlist rows
to append.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.operators.upsert import keyed_upsert
from hygeia.session import materialize, measured
from hygeia.plans.snapshot import DATA_T, ITEM_T, META_T, SUG_T

REJECT_REASON = "L0 Junk Data."          # fixed values
HOLD_REASON = "New Masterlist Draft Record."
ENTITLEMENT_COL = "entitliment_level"

DECISION_SCHEMA = ("decision_id bigint, ts timestamp, kind string, execution_id string, field_name string, "
                   "accepted_value string, rank int, current_status string, core_count string, type string, "
                   "value string, metadata map<string,string>")


def _latest(decisions: DataFrame, kind: str) -> DataFrame:
    d = decisions.where(F.col("kind") == kind)
    return (d.groupBy("execution_id").agg(F.max_by(F.struct(*[c for c in d.columns if c != "execution_id"]),
                                                   F.struct("ts", "decision_id")).alias("d"))
            .select("execution_id", "d.*"))


def _with_first(data: Column, new_first: Column) -> Column:
    return F.concat(F.array(new_first), F.slice(data, 2, F.greatest(F.size(data) - 1, F.lit(0))))


def _set_status(arr: Column, status: str) -> Column:
    return F.transform(arr, lambda s: s.withField("status", F.lit(status)))


def _items_of(d0: Column) -> Column:
    return F.coalesce(d0["invalidValues"], F.array().cast(f"array<{ITEM_T}>"))


def apply_rejections(snapshots: DataFrame, decisions: DataFrame, as_of: str, updated_by: str = "reviewer"
                     ) -> tuple[DataFrame, DataFrame]:
    """Every suggestion Rejected, status REJECTED + reason, history replaced (to = from).

    Returns (rewritten snapshots of the decided executions, execution updates).
    """
    rej = _latest(decisions, "reject").select("execution_id", F.col("current_status").alias("_cs"))
    j = snapshots.join(rej, "execution_id")
    out = j.withColumn("data", _rejected(F.col("data"), F.col("_cs"), as_of, updated_by)).drop("_cs")
    upd = rej.select(F.col("execution_id").alias("exec_id"), F.lit(ENTITLEMENT_COL).alias("path"),
                     F.lit(REJECT_REASON).alias("value"))
    return out, upd


def _rejected(data: Column, status: Column, as_of: str, updated_by: str) -> Column:
    """The data of a snapshot after its rejection."""
    d0 = F.get(data, 0)
    items = _items_of(d0)
    new_items = F.transform(items, lambda it: it
                            .withField("currentStatus", status)
                            .withField("comparingData", _set_status(it["comparingData"], "Rejected"))
                            .withField("metadata", F.transform(it["metadata"], lambda m: m.withField(
                                "comparingData", _set_status(m["comparingData"], "Rejected")))))
    frm = F.flatten(F.transform(items, lambda it: F.concat(F.array(it["value"]),
                                                            F.transform(it["metadata"], lambda m: m["value"]))))
    fld = F.flatten(F.transform(items, lambda it: F.concat(F.array(it["field"]),
                                                            F.transform(it["metadata"], lambda m: m["name"]))))
    hist = F.struct(F.lit(as_of).alias("updatedOn"), F.lit(updated_by).alias("updatedBy"), frm.alias("from"),
                    frm.alias("to"), fld.alias("valueField"), F.transform(fld, lambda x: F.lit("reject")).alias("source"))
    nd = (d0.withField("invalidValues", new_items).withField("standardization_status", F.lit("REJECTED"))
          .withField("reason", F.lit(REJECT_REASON)).withField("history", hist))
    return _with_first(data, nd)


def _in_place(snapshots: DataFrame, by_row: Callable[[DataFrame], DataFrame],
              by_id: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The complete table after ``by_row``, which rewrites each row where it stands: one pass, no upsert.  Rows whose snapshot id
    isn't their own (null, or on several rows) go through ``by_id``, as an upsert replaces all rows of an id at once."""
    h = F.xxhash64("snapshot_id")
    shared = materialize(snapshots.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("snapshot_id").isNull()).alias("none"))
                         .where("n > 1 or none").select("_h"), "shared_ids")
    if shared.isEmpty():
        return by_row(snapshots)
    shared, rows = measured(shared), snapshots.withColumn("_h", h)
    some = materialize(rows.join(shared, "_h", "left_semi").select(*snapshots.columns), "shared_rows")
    return by_row(rows.join(shared, "_h", "left_anti").select(*snapshots.columns)).unionByName(by_id(some))


def rejected_snapshots(snapshots: DataFrame, decisions: DataFrame, as_of: str, updated_by: str = "reviewer") -> DataFrame:
    """The complete snapshot table after the rejections of a batch."""
    def by_row(rows: DataFrame) -> DataFrame:
        rej = measured(materialize(_latest(decisions, "reject").select("execution_id", F.struct("current_status").alias("_rej")), "rejections"))
        data = F.when(F.col("_rej").isNotNull(), _rejected(F.col("data"), F.col("_rej.current_status"), as_of, updated_by))
        return rows.join(rej, "execution_id", "left").withColumn("data", data.otherwise(F.col("data"))).select(*snapshots.columns)

    def by_id(rows: DataFrame) -> DataFrame:
        return keyed_upsert(rows, apply_rejections(rows, decisions, as_of, updated_by)[0], ["snapshot_id"])

    return _in_place(snapshots, by_row, by_id)


def all_resolved(d0: Column) -> Column:
    """Every item and every metadata item valid."""
    return F.forall(_items_of(d0), lambda it: (F.coalesce(it["validation_status"], F.lit("")) == "valid")
                    & F.forall(F.coalesce(it["metadata"], F.array()), lambda m: F.coalesce(
                        m["validation_status"], F.lit("")) == "valid"))


CHANGE_T = "struct<field:string,`from`:string,`to`:string,source:string,path:string,value:string>"
UPDATE_T = "struct<path:string,value:string>"
STATE_T = f"struct<d0:{DATA_T},applied:int,updates:array<{UPDATE_T}>>"


def _first(arr: Column, test) -> Column:
    """0-based position of the first element that passes ``test`` (-1: none)."""
    return F.coalesce(F.array_position(F.transform(arr, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int") - 1


def _judge(comparing: Column, accepted: Column) -> Column:
    return F.transform(comparing, lambda s: s.withField(
        "status", F.when(s["suggestion"] == accepted, F.lit("Accepted")).otherwise(F.lit("Rejected"))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _metas(item: Column) -> Column:
    return F.coalesce(item["metadata"], F.array().cast(f"array<{META_T}>"))


def _target(items: Column, dec: Column) -> Column:
    """What an approval decides: the first item that has its field, or holds it among its metadata; the item whose
    cascade it drives; whether a suggestion equals the accepted value, and the rank of that one."""
    name, acc = dec["field_name"], dec["accepted_value"]
    at = _first(items, lambda it: (it["field"] == name) | F.exists(_metas(it), lambda m: m["name"] == name))
    parent = _first(items, lambda it: it["field"] == name)

    def where(p: Column) -> Column:
        item = F.get(items, p["at"])
        return F.struct(p["at"].alias("at"), p["parent"].alias("parent"), item.alias("item"),
                        F.coalesce(item["field"] == name, F.lit(False)).alias("primary"),
                        _first(_metas(item), lambda m: m["name"] == name).alias("meta"))

    def ranked(t: Column) -> Column:
        meta = F.get(_metas(t["item"]), t["meta"])
        pick = lambda f: F.when(t["primary"], t["item"][f]).otherwise(meta[f])
        ranks = F.transform(F.filter(F.coalesce(pick("comparingData"), F.array().cast(f"array<{SUG_T}>")),
                                     lambda s: s["suggestion"] == acc), lambda s: s["rank"])
        return _let(ranks, lambda r: F.struct(
            t["at"].alias("at"), t["parent"].alias("parent"), t["primary"].alias("primary"),
            F.when(~t["primary"], t["meta"]).alias("meta"), pick("value").alias("value"), pick("mapping").alias("path"),
            (F.size(r) > 0).alias("found"), F.when(F.size(r) > 0, F.coalesce(dec["rank"], F.array_max(r))).alias("rank"),
            F.when(F.size(r) > 0, F.lit("suggestion")).otherwise(F.lit("dropdown")).alias("source")))

    return _let(F.struct(at.alias("at"), parent.alias("parent")), lambda p: _let(where(p), ranked))


def _changes(items: Column, dec: Column, t: Column) -> Column:
    """The decided field, then the metadata that follow it."""
    def manual(m: Column) -> Column:
        return (m["name"] == "coreCount") & dec["core_count"].isNotNull()

    def cascaded(m: Column) -> Column:
        by_rank = F.get(F.filter(m["comparingData"], lambda s: s["rank"] == t["rank"]), 0)["suggestion"]
        by_drop = F.get(F.filter(F.coalesce(dec["dropdown"], F.array().cast("array<struct<key:string,value:string>>")),
                                 lambda e: F.lower(e["key"]) == F.lower(m["name"])), 0)["value"]
        return F.nullif(F.when(manual(m), dec["core_count"]).when(t["rank"].isNotNull(), by_rank).otherwise(by_drop), F.lit(""))

    first = F.struct(dec["field_name"].alias("field"), t["value"].alias("from"), dec["accepted_value"].alias("to"),
                     t["source"].alias("source"), t["path"].alias("path"), dec["accepted_value"].alias("value")).cast(CHANGE_T)
    parent = F.coalesce(_metas(F.get(items, t["parent"])), F.array().cast(f"array<{META_T}>"))
    down = F.transform(parent, lambda m: _let(cascaded(m), lambda v: F.struct(
        m["name"].alias("field"), m["value"].alias("from"), F.coalesce(v, m["value"]).alias("to"),
        F.when(manual(m), F.lit("manual")).otherwise(t["source"]).alias("source"), m["mapping"].alias("path"),
        v.alias("value")))).cast(f"array<{CHANGE_T}>")
    return F.concat(F.array(first), down)


def _settled(items: Column, dec: Column, t: Column) -> Column:
    """The items after the decision."""
    acc = dec["accepted_value"]

    def meta(m: Column, j: Column, i: Column) -> Column:
        follows, decided = i == t["parent"], (i == t["at"]) & (j == t["meta"])
        accepted = lambda s: F.when(follows, F.coalesce(s["rank"] == t["rank"], F.lit(False))).otherwise(s["suggestion"] == acc)
        marked = m.withField("validation_status", F.lit("valid")).withField("comparingData", F.transform(
            m["comparingData"], lambda s: s.withField("status", F.when(accepted(s), F.lit("Accepted")).otherwise(F.lit("Rejected")))))
        return F.when(follows | F.coalesce(decided, F.lit(False)), marked).otherwise(m)

    def item(it: Column, i: Column) -> Column:
        own = (i == t["at"]) & t["primary"]
        return (it.withField("comparingData", F.when(own, _judge(it["comparingData"], acc)).otherwise(it["comparingData"]))
                .withField("validation_status", F.when(own, F.lit("valid")).otherwise(it["validation_status"]))
                .withField("currentStatus", F.when(own, F.coalesce(dec["current_status"], it["currentStatus"])).otherwise(it["currentStatus"]))
                .withField("metadata", F.transform(_metas(it), lambda m, j: meta(m, j, i))))

    return F.transform(items, item)


def _updates(d0: Column, changes: Column) -> Column:
    """What goes into the execution: the changes with a value; once all is resolved, the whole history again
    by the paths of the snapshot's fields, then the verdict."""
    written = F.transform(F.filter(changes, lambda c: c["value"].isNotNull()),
                          lambda c: F.struct(c["path"].alias("path"), c["value"].alias("value")))
    paths = F.flatten(F.transform(_items_of(d0), lambda it: F.concat(
        F.array(F.struct(it["field"].alias("n"), it["mapping"].alias("p"))),
        F.transform(_metas(it), lambda m: F.struct(m["name"].alias("n"), m["mapping"].alias("p"))))))
    h = d0["history"]
    replay = _let(paths, lambda of: F.transform(F.arrays_zip(h["valueField"].alias("f"), h["to"].alias("t")), lambda z: F.struct(
        F.try_element_at(F.filter(of, lambda q: q["n"] == z["f"]), F.lit(-1))["p"].alias("path"), z["t"].alias("value"))))
    verdict = F.array(F.struct(F.lit("isValid").alias("path"), F.lit("true").alias("value")))
    final = F.concat(F.filter(replay, lambda u: u["value"].isNotNull()).cast(f"array<{UPDATE_T}>"), verdict.cast(f"array<{UPDATE_T}>"))
    return F.concat(written.cast(f"array<{UPDATE_T}>"),
                    F.when(d0["standardization_status"] == "ACCEPTED", final).otherwise(F.array().cast(f"array<{UPDATE_T}>")))


def _approve(state: Column, dec: Column, as_of: str, updated_by: str) -> Column:
    """One approval applied to one snapshot: target, cascade, history, resolution, updates."""
    def with_changes(t: Column, changes: Column) -> Column:
        d0 = state["d0"]
        h = d0["history"]
        put = lambda old, new: F.concat(F.coalesce(old, F.array().cast("array<string>")),
                                        F.transform(changes, lambda c: c[new]))
        history = F.struct(F.lit(as_of).alias("updatedOn"), F.lit(updated_by).alias("updatedBy"),
                           put(h["from"], "from").alias("from"), put(h["to"], "to").alias("to"),
                           put(h["valueField"], "field").alias("valueField"), put(h["source"], "source").alias("source"))
        n0 = d0.withField("invalidValues", _settled(_items_of(d0), dec, t)).withField("history", history)
        n0 = _let(n0, lambda d: d.withField("standardization_status",
                                            F.when(all_resolved(d), F.lit("ACCEPTED")).otherwise(F.lit("PENDING"))))
        return _let(n0, lambda d: F.struct(d.alias("d0"), (state["applied"] + 1).alias("applied"),
                                           F.concat(state["updates"], _updates(d, changes)).alias("updates")).cast(STATE_T))

    def step(t: Column) -> Column:
        return F.when(t["at"] >= 0, _let(_changes(_items_of(state["d0"]), dec, t), lambda c: with_changes(t, c))).otherwise(state)

    return _let(_target(_items_of(state["d0"]), dec), step)


def _with_dropdown(approvals: DataFrame, masterlist: DataFrame) -> DataFrame:
    """Approvals with ``dropdown``: the metadata of the first Published record of that type and value."""
    pub = masterlist.where(F.col("status") == "Published")
    drop = (pub.select(F.lower("type").alias("_lt"), F.col("data.value").alias("_dv"),
                       F.col("data.metadata").alias("_dm"), "ordinal")
            .groupBy("_lt", "_dv").agg(F.min_by("_dm", "ordinal").alias("dropdown")))
    return approvals.join(drop, (F.lower("field_name") == F.col("_lt")) & (F.col("accepted_value") == F.col("_dv")), "left")


def _in_order(wanted: Column) -> Column:
    """Aggregate: the approvals among the ``wanted`` rows in the order (ts, id)."""
    return F.array_sort(F.collect_list(F.when(wanted, F.struct(
        "ts", "decision_id", "field_name", "accepted_value", "rank", "current_status", "core_count",
        F.map_entries("dropdown").alias("dropdown")))))


def _folded(decs: str, as_of: str, updated_by: str) -> Column:
    start = F.struct(F.get(F.col("data"), 0).alias("d0"), F.lit(0).alias("applied"),
                     F.array().cast(f"array<{UPDATE_T}>").alias("updates")).cast(STATE_T)
    return F.aggregate(decs, start, lambda s, d: _approve(s, d, as_of, updated_by))


def apply_approvals(snapshots: DataFrame, decisions: DataFrame, masterlist: DataFrame, as_of: str,
                    updated_by: str = "reviewer") -> tuple[DataFrame, DataFrame]:
    """X5-X9 for every approval of a batch, in the order (ts, decision id) of each execution.

    The target is the first item whose field, or one of whose metadata, has the decided name.  A suggestion equal to
    the accepted value is Accepted, others Rejected; on a primary field the last equal rank drives the cascade over
    its metadata unless the decision names a rank (D20); without an equal suggestion the source is 'dropdown' and
    the metadata come from the first Published record of that type (case-insensitive) and value (J18);
    ``core_count`` overrides coreCount.  The snapshot is ACCEPTED when everything is valid (A11), else PENDING; on
    full resolution the whole history is written once more (X9).  Decisions without a target change nothing.
    Returns (rewritten snapshots, execution updates (exec_id, path, value, seq)).
    """
    app = _with_dropdown(decisions.where(F.col("kind") == "approve"), masterlist)
    # the actions of reviewers on one record: a short list
    per = app.groupBy("execution_id").agg(_in_order(F.lit(True)).alias("_decs"))
    j = snapshots.where(F.size("data") > 0).join(per, "execution_id").withColumn("_s", _folded("_decs", as_of, updated_by))
    # written, then read for both results: a filter on the folded state would fold a second time
    j = materialize(j.select(*snapshots.columns, "_s"), "folded").where("_s.applied > 0")
    out = j.withColumn("data", _with_first(F.col("data"), F.col("_s.d0")))
    upd = (j.select(F.col("execution_id").alias("exec_id"), F.posexplode("_s.updates").alias("seq", "u"))
           .where(F.coalesce(F.col("u.path"), F.lit("")) != "").where(~F.col("u.path").startswith("processor_details."))
           .select("exec_id", F.col("u.path").alias("path"), F.col("u.value").alias("value"), "seq"))
    return out.select(*snapshots.columns), upd


def review_snapshots(snapshots: DataFrame, decisions: DataFrame, masterlist: DataFrame, drafted: DataFrame, as_of: str,
                     updated_by: str = "reviewer") -> DataFrame:
    """The complete new snapshot table after a batch: approvals, then rejections of what is not decided later by an
    approval, then holds for drafted values; untouched snapshots are kept (S9).

    One pass: a row meets the decisions of its execution and the types drafted for it, and is rewritten where it stands.
    Holds look at fields and values only, which approvals and rejections leave as they are, so they are found before."""
    drafted = materialize(drafted.select("execution_id", "type", F.struct("data.value").alias("data")), "drafted")
    decided = decisions.where(F.col("kind").isin("approve", "reject"))
    approve = F.col("kind") == "approve"

    def by_row(rows: DataFrame) -> DataFrame:
        app = _with_dropdown(decided.where(approve), masterlist)
        both = app.unionByName(decided.where(~approve).withColumn("dropdown", F.lit(None).cast("map<string,string>")), True)
        per = materialize(both.groupBy("execution_id").agg(_in_order(approve).alias("_decs"), F.max_by(
            F.struct("kind", "current_status"), F.struct("ts", "decision_id")).alias("_last")), "per_execution")
        types = materialize(_held_types(rows, drafted), "held_types")
        j = rows.join(measured(types), "snapshot_id", "left").join(measured(per), "execution_id", "left")
        j = j.withColumn("_s", F.when((F.size("data") > 0) & (F.size("_decs") > 0), _folded("_decs", as_of, updated_by)))
        data = F.col("data")
        j = j.withColumn("data", F.when(F.col("_s.applied") > 0, _with_first(data, F.col("_s.d0"))).otherwise(data))
        j = j.withColumn("data", F.when(F.col("_last.kind") == "reject", _rejected(data, F.col("_last.current_status"), as_of, updated_by))
                         .otherwise(data))
        j = j.withColumn("data", F.when(_holds(data, F.col("_types")), _held(data, F.col("_types"), as_of, updated_by)).otherwise(data))
        return j.select(*snapshots.columns)

    def by_id(rows: DataFrame) -> DataFrame:
        approved, _ = apply_approvals(rows, decisions, masterlist, as_of, updated_by)
        cur = _upsert(rows, approved, "approved")
        last = (decided.groupBy("execution_id").agg(F.max_by("kind", F.struct("ts", "decision_id")).alias("_k"))
                .where("_k = 'reject'").select("execution_id"))
        rejected, _ = apply_rejections(cur, decisions.join(last, "execution_id", "left_semi"), as_of, updated_by)
        cur = _upsert(cur, rejected, "rejected")
        return _upsert(cur, hold_snapshots(cur, drafted, as_of, updated_by), "held")

    return _in_place(snapshots, by_row, by_id)


def _upsert(current: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """One step of a batch, written: the next step reads a table, not the rewriting expressions twice over."""
    return materialize(keyed_upsert(current, materialize(changes, name), ["snapshot_id"]), f"{name}_all")


def history_changes(snapshots: DataFrame) -> DataFrame:
    """A10: history -> (execution_id, field, pos, from, to) in first-seen order; short lists pad ''."""
    h = F.get(F.col("data"), 0)["history"]
    z = snapshots.select("execution_id", F.size(h["valueField"]).alias("_n"),
                         F.posexplode(F.arrays_zip(h["valueField"].alias("f"), h["from"].alias("fr"),
                                                   h["to"].alias("t"))).alias("pos", "z"))
    z = z.where(F.col("pos") < F.col("_n"))
    return z.select("execution_id", F.col("z.f").alias("field"), "pos",
                    F.coalesce(F.col("z.fr"), F.lit("")).alias("from"), F.coalesce(F.col("z.t"), F.lit("")).alias("to"))


# Draft document layout per type (paths the draft builder writes)
DRAFT_LAYOUT = {
    "cpumodel": ("CPUModel", "platformProfile.sut.Summary.Server.CPUModel",
                 [("Family", "mapping_Family", "processor_details.family"),
                  ("coreCount", "mapping_coreCount", "platformProfile.sut.Summary.CPU.CPU(s)")]),
    "instancetype": ("instanceType", "sutInstanceMetadata.instanceType",
                     [("CPUModel", "mapping_CPUModel", "platformProfile.sut.Summary.Server.CPUModel"),
                      ("cloudProvider", "mapping_cloudProvider", "sutInstanceMetadata.cloudProvider"),
                      ("Family", "mapping_Family", "processor_details.family"),
                      ("coreCount", "mapping_coreCount", "platformProfile.sut.Summary.CPU.CPU(s)")]),
    "benchmark": ("Benchmark", "benchmarkCategory", [("BenchmarkType", "mapping_benchmarkType", "benchmarkType")]),
}


def _parts(entries: Column) -> Column:
    """All parts of a list of entries, each in the list's order, from the empty one to the whole."""
    none = F.array(F.slice(entries, 1, 0))
    return F.aggregate(entries, none, lambda acc, e: F.concat(acc, F.transform(acc, lambda p: F.concat(p, F.array(e)))))


def _first_holders(requests: DataFrame) -> DataFrame:
    """Requests that no earlier one of their type and value holds: (actual_type, value, req_meta, r)."""
    entries = F.array_sort(F.map_entries("req_meta"))
    own = (requests.withColumn("_own", entries).groupBy("actual_type", "value", "_own")
           .agg(F.min_by(F.struct("decision_id", "mapping", "execution_id"),
                         F.struct("decision_id", "execution_id")).alias("r")))
    by_part = (own.select("actual_type", "value", F.explode(_parts(F.col("_own"))).alias("_own"),
                          F.col("r.decision_id").alias("_first"))
               .groupBy("actual_type", "value", "_own").agg(F.min("_first").alias("_first")))
    # the request itself holds its metadata, so every one finds a row; requests without an id, or of equal ids, both stay
    held = own.join(by_part, ["actual_type", "value", "_own"]).where(
        ~F.coalesce(F.col("_first") < F.col("r.decision_id"), F.lit(False)))
    return held.select("actual_type", "value", F.map_from_entries("_own").alias("req_meta"), "r")


def draft_records(masterlist: DataFrame, drafts: DataFrame, as_of: str) -> DataFrame:
    """X11 + J16: Draft masterlist rows for requests (type, value, metadata) that are not duplicates.

    Duplicate = same type and value and every non-empty requested metadata value equal,
    any status, or by an earlier request of the batch: its draft would hold them.  Containment is transitive, so any earlier
    request that holds all of a request's metadata settles it, drafted itself or not.  Each request puts down all parts of
    its metadata (at most 16: a layout names at most 4), the first request per part is pre-aggregated, and a request
    looks up its own metadata: no pairs inside a type and value.
    Metadata that the type's layout doesn't name, and empty ones, are left out.
    """
    spark = masterlist.sparkSession
    layout = spark.createDataFrame([(k, t, m, [n for n, _, _ in names]) for k, (t, m, names) in DRAFT_LAYOUT.items()],
                                   "tkey string, actual_type string, mapping string, names array<string>")
    req = (drafts.where(F.col("kind") == "draft").where(F.coalesce(F.col("value"), F.lit("")) != "")
           .join(F.broadcast(layout), F.lower("type") == F.col("tkey"))
           .withColumn("req_meta", F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                                                lambda k, v: F.array_contains("names", k) & (F.coalesce(v, F.lit("")) != ""))))
    ml = masterlist.select(F.col("type").alias("_mt"), F.col("data.value").alias("_mv"),
                           F.col("data.metadata").alias("_mm"))
    dup = req.join(ml, (F.col("actual_type") == F.col("_mt")) & (F.col("value") == F.col("_mv")))
    dup = dup.where(F.forall(F.map_entries("req_meta"), lambda e: F.coalesce(
        F.col("_mm")[e["key"]] == e["value"], F.lit(False)))).select("decision_id").distinct()
    fresh = req.join(dup, "decision_id", "left_anti")
    first = _first_holders(fresh)
    meta_map = {k: m for k, (_, _, m) in DRAFT_LAYOUT.items()}
    kv_cols = []
    for k, pairs in meta_map.items():
        kv = []
        for name, key, path in pairs:
            kv += [F.lit(name), F.col("req_meta")[F.lit(name)], F.lit(key), F.lit(path)]
        kv_cols.append((DRAFT_LAYOUT[k][0], F.create_map(*kv)))
    md = F.lit(None).cast("map<string,string>")
    for t, c in kv_cols:
        md = F.when(F.col("actual_type") == t, c).otherwise(md)
    return first.select(
        F.col("r.decision_id").alias("ordinal"),
        F.sha2(F.concat_ws("\u0001", F.lit("draft"), F.col("actual_type"), F.col("value"),
                           F.to_json("req_meta")), 256).alias("ml_id"),
        F.col("actual_type").alias("type"), F.lit("Draft").alias("status"),
        F.struct(F.col("value").alias("value"), F.col("r.mapping").alias("mapping"), md.alias("metadata")).alias("data"),
        F.col("r.execution_id").alias("execution_id"))


def hold_snapshots(snapshots: DataFrame, drafted: DataFrame, as_of: str, updated_by: str = "reviewer") -> DataFrame:
    """Snapshots holding a drafted value (by execution id when given, else any invalid value)
    with an item of that type -> ON HOLD, reason, stamp; that item's suggestions REJECTED."""
    cand = snapshots.join(_held_types(snapshots, drafted), "snapshot_id")
    return (cand.where(_holds(F.col("data"), F.col("_types")))
            .withColumn("data", _held(F.col("data"), F.col("_types"), as_of, updated_by)).select(*snapshots.columns))


def _held_types(snapshots: DataFrame, drafted: DataFrame) -> DataFrame:
    """(snapshot_id, _types): the drafted types, in lower case, that ask a snapshot to be held."""
    # read twice and joined with all snapshots: a few records, as drafts are distinct
    drafted = materialize(drafted.select("execution_id", F.col("data.value").alias("_hv"), F.col("type").alias("_ht")), "drafted_types")
    drafted = measured(drafted)
    by_exec = drafted.where(F.col("execution_id").isNotNull()).select("execution_id", "_ht")
    by_val = drafted.where(F.col("execution_id").isNull()).select("_hv", "_ht")
    d0 = F.get(F.col("data"), 0)
    s1 = snapshots.select("snapshot_id", "execution_id").join(by_exec, "execution_id")
    # Equi-join on the exploded invalid values (no nested-loop join); a null id meets no snapshot
    vals = (snapshots.select("snapshot_id", F.explode(F.transform(_items_of(d0), lambda it: it["value"])).alias("_hv"))
            .join(by_val, "_hv"))
    return (s1.select("snapshot_id", "_ht").unionByName(vals.select("snapshot_id", "_ht"))
            .groupBy("snapshot_id").agg(F.collect_set(F.lower("_ht")).alias("_types")))  # drafted types: a few


def _holds(data: Column, types: Column) -> Column:
    return F.exists(_items_of(F.get(data, 0)), lambda it: F.array_contains(types, F.lower(it["field"])))


def _held(data: Column, types: Column, as_of: str, updated_by: str) -> Column:
    """The data of a snapshot that is put on hold for the drafted ``types``."""
    d0 = F.get(data, 0)
    held = lambda it: F.array_contains(types, F.lower(it["field"]))
    nd = (d0.withField("standardization_status", F.lit("ON HOLD")).withField("reason", F.lit(HOLD_REASON))
          .withField("history", d0["history"].withField("updatedOn", F.lit(as_of))
                     .withField("updatedBy", F.lit(updated_by)))
          .withField("invalidValues", F.transform(_items_of(d0), lambda it: F.when(
              held(it), it.withField("currentStatus", F.lit("ON HOLD"))
              .withField("comparingData", _set_status(it["comparingData"], "REJECTED"))
              .withField("metadata", F.transform(it["metadata"], lambda m: m.withField(
                  "comparingData", _set_status(m["comparingData"], "REJECTED"))))).otherwise(it))))
    return _with_first(data, nd)


def draft_ids(masterlist: DataFrame) -> DataFrame:
    """Ids of Draft masterlist records: the record's own id, else the execution it was drafted for."""
    own = [F.col(c).cast("string") for c in ("ml_id", "execution_id", "_id") if c in masterlist.columns]
    return masterlist.where(F.col("status") == "Draft").select(F.coalesce(*own).alias("id"))
