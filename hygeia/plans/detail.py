"""A stored review snapshot as a reviewer opens it (R6): header, data as found, changes by field, acceptance on reading.

One row or one group of rows per execution: of several snapshots the one with the least id counts, as in J5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.functions import paths as P
from hygeia.plans.snapshot import PROTECTED

#: Header columns and their paths in the execution document (fixed values).
HEADER = {"benchmarkType": "benchmark_type", "benchmarkCategory": "benchmark_category",
          "sutInstanceMetadata.sutType": "sut_type", "runCategory": "run_category", "createdOn": "created_on",
          "tester": "tester", "resultType": "result_type"}


def _first_data(snapshots: DataFrame, **parts) -> DataFrame:
    """(execution_id, snapshot_id and ``parts`` of the first data element) of the first snapshot with data per execution."""
    d0 = F.get(F.col("data"), 0)
    packed = F.struct("snapshot_id", *[part(d0).alias(name) for name, part in parts.items()])
    return (snapshots.where(F.size("data") > 0).groupBy("execution_id").agg(F.min_by(packed, F.col("snapshot_id")).alias("_s"))
            .select("execution_id", "_s.*"))


def _accepts(status: Column, valid: Column) -> Column:
    return F.coalesce(valid, F.lit(False)) & ~F.upper(F.coalesce(status, F.lit(""))).isin(*PROTECTED)


def headers(snapshots: DataFrame, executions: DataFrame, doc: Column, validated: DataFrame,
            id_col: str = "exec_id") -> DataFrame:
    """One row per stored snapshot with the columns of its execution, which alone names type and category (no
    execution: null); sutType by literal key or nested.  A column of ``executions`` goes before the document's path.
    The status is PENDING where the snapshot has none, and ACCEPTED where the execution passes now (X2 on reading)."""
    snaps = _first_data(snapshots, status=lambda d: d["standardization_status"], reason=lambda d: d["reason"],
                        updated_on=lambda d: d["history"]["updatedOn"], updated_by=lambda d: d["history"]["updatedBy"],
                        n_changed_fields=lambda d: F.size(F.array_distinct(F.coalesce(
                            d["history"]["valueField"], F.array().cast("array<string>")))).cast("bigint"))
    wanted = executions.join(snaps.select(F.col("execution_id").alias("_k")), F.col(id_col).cast("string") == F.col("_k"),
                             "left_semi")
    in_doc = [p for p in HEADER if p not in executions.columns]
    texts = P.add_path_texts(wanted, doc, in_doc, prefix="_h", infer=True, strip=False)
    cells = [(F.col(f"_h{in_doc.index(p)}") if p in in_doc else F.col(p).cast("string")).alias(n) for p, n in HEADER.items()]
    first = (texts.select(F.col(id_col).cast("string").alias("execution_id"), F.struct(*cells).alias("_c"))
             .groupBy("execution_id").agg(F.min("_c").alias("_c")).select("execution_id", "_c.*"))
    live = (validated.groupBy(F.col(id_col).cast("string").alias("execution_id")).agg(F.min("isValid").alias("_valid")))
    j = snaps.join(first, "execution_id", "left").join(live, "execution_id", "left")
    status = F.when(_accepts(F.col("status"), F.col("_valid")), F.lit("ACCEPTED")).otherwise(F.coalesce("status", F.lit("PENDING")))
    return j.select("snapshot_id", "execution_id", *HEADER.values(), status.alias("status"), "reason", "updated_on", "updated_by",
                    "n_changed_fields")


def existing_data(snapshots: DataFrame) -> DataFrame:
    """What was found, per invalid item its own row (``data_pos`` 0) and one for each of its metadata."""
    items = _first_data(snapshots, items=lambda d: d["invalidValues"]).select(
        "execution_id", F.posexplode("items").alias("field_pos", "it"))

    def row(e: Column, name: str) -> Column:
        return F.struct(e[name].alias("name"), e["value"].alias("value"), e["validation_status"].alias("validation_status"))

    none = F.array().cast("array<struct<name:string,value:string,validation_status:string>>")
    rows = F.concat(F.array(row(F.col("it"), "field")),
                    F.coalesce(F.transform("it.metadata", lambda m: row(m, "name")), none))
    return items.select("execution_id", "field_pos", F.col("it.field").alias("invalid_field"),
                        F.coalesce("it.currentStatus", F.lit("invalid")).alias("current_status"),
                        F.posexplode(rows).alias("data_pos", "r")).select(
        "execution_id", "field_pos", "invalid_field", "current_status", "data_pos", "r.name", "r.value", "r.validation_status")


def changes_by_field(snapshots: DataFrame) -> DataFrame:
    """A10: the history by field, in the order in which fields first occur, with the lists of old and new values.

    The length is that of the list of fields; shorter lists are filled up with ''.  Built in the row: a record has a few fields."""
    none = F.array().cast("array<string>")
    h = _first_data(snapshots, f=lambda d: F.coalesce(d["history"]["valueField"], none),
                    fr=lambda d: F.coalesce(d["history"]["from"], none), to=lambda d: F.coalesce(d["history"]["to"], none))

    def padded(values: str) -> Column:
        return F.transform("f", lambda f, i: F.struct(f.alias("f"), F.when(i < F.size(values), F.get(F.col(values), i))
                                                      .otherwise(F.lit("")).alias("v")))

    def of(values: str) -> Column:
        return F.transform(F.filter(F.col(values), lambda e: e["f"].eqNullSafe(F.col("field"))), lambda e: e["v"])

    rows = (h.select("execution_id", "f", padded("fr").alias("fr"), padded("to").alias("to"))
            .select("execution_id", "fr", "to", F.posexplode(F.array_distinct("f")).alias("field_pos", "field")))
    return rows.select("execution_id", "field_pos", "field", of("fr").alias("from"), of("to").alias("to"))


def accept_on_read(snapshots: DataFrame, validated: DataFrame, id_col: str = "exec_id") -> tuple[DataFrame, DataFrame]:
    """X2 on reading: snapshots whose execution passes now, and what that does to both tables.

    Returns (rewritten snapshots: ACCEPTED unless ACCEPTED, REJECTED or ON HOLD, every other column as it was;
    verdict rows (exec_id, isValid true, an empty payload, no field status) for all of these executions)."""
    valid = validated.where("isValid").select(F.col(id_col).cast("string").alias("execution_id")).distinct()
    seen = snapshots.where(F.size("data") > 0).join(valid, "execution_id", "left_semi")
    d0 = F.get(F.col("data"), 0)
    accepted = seen.where(_accepts(d0["standardization_status"], F.lit(True))).withColumn("data", F.transform(
        "data", lambda d, i: F.when(i == 0, d.withField("standardization_status", F.lit("ACCEPTED"))).otherwise(d)))
    kinds = {f.name: f.dataType for f in validated.schema.fields}
    cleared = seen.select(F.col("execution_id").alias("exec_id")).distinct().select(
        "exec_id", F.lit(True).alias("isValid"), F.array().cast(kinds["invalidPayload"]).alias("invalidPayload"),
        F.lit(None).cast(kinds["fieldStatus"]).alias("fieldStatus"))
    return accepted.select(*snapshots.columns), cleared
