"""Validation of every execution document against a RuleSet.

Plan shape: one pass over the executions.  Each mapped path is extracted once
from the parsed document; the processor dimension and every per-field rule
table are joined by broadcast (size-checked, else shuffle join); the best
metadata configuration is chosen in-row with higher-order functions.  No
exec-level shuffle is needed when the rule tables are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.functions import paths as P
from hygeia.functions import text as T
from hygeia.functions.scores import let
from hygeia.plans.rules import PROCESSOR_KEY_FIELD, PROCESSOR_PREFIX, RuleSet, is_integer_field, types_map_col
from hygeia.session import sized_broadcast

META_T = "struct<name:string,value:string,validation_status:string,mapping:string>"


def empty_meta() -> Column:
    return F.array().cast(f"array<{META_T}>")


def metadata_pairs(rules: RuleSet) -> list[tuple[str, str]]:
    """Distinct (metadata name, path) pairs that configurations require (small rule metadata)."""
    if "pairs" in rules.extra:
        return rules.extra["pairs"]
    rows = (rules.configs.select(F.explode("cfgs").alias("c")).select(F.explode("c.reqs").alias("r"))
            .select("r.name", "r.path").distinct().limit(100_001).collect())
    if len(rows) > 100_000:
        raise ValueError("too many distinct metadata requirements for one validation plan")
    pairs = {(r["name"], r["path"]) for r in rows}
    for lst in rules.meta_paths.values():
        pairs.update(lst)
    rules.extra["pairs"] = sorted(pairs)
    return rules.extra["pairs"]


def metadata_paths(rules: RuleSet) -> list[str]:
    return sorted({p for _, p in metadata_pairs(rules) if p})


def _pair_key(name: Column, path: Column) -> Column:
    return F.concat(name, F.lit("\u0001"), path)


def _placed(cfgs: str, pairs: list[tuple[str, str]]) -> Column:
    """Configurations whose requirements say where their pair stands in ``pairs`` (``at``, -1: nowhere), looked up
    once per rule and not once per row."""
    keys = F.array(*[_pair_key(F.lit(n), F.lit(p)) for n, p in pairs]) if pairs else F.array().cast("array<string>")
    return F.transform(cfgs, lambda c: F.struct(c["ordinal"].alias("ordinal"), c["ml_id"].alias("ml_id"), F.transform(
        c["reqs"], lambda r: F.struct(
            r["name"].alias("name"), r["path"].alias("path"), r["required_proc"].alias("required_proc"),
            (F.array_position(keys, _pair_key(r["name"], r["path"])) - 1).cast("int").alias("at"))).alias("reqs")))


class Values:
    """Per-row observed texts: one column per document / processor path (no map, so
    Catalyst never re-inlines the extraction expressions at each access)."""

    def __init__(self, cols: dict[str, str]):
        self.cols = cols

    def get(self, path: str) -> Column:
        c = self.cols.get(path)
        return F.col(c) if c else F.lit("")

    def dynamic(self) -> Column:
        """map path -> text built from column references only (for lookups inside lambdas)."""
        kv = []
        for p, c in self.cols.items():
            kv += [F.lit(p), F.col(c)]
        return F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")


def with_values(rules: RuleSet, executions: DataFrame, doc: Column, meta_paths: list[str] | None = None
                ) -> tuple[DataFrame, Values]:
    """Adds ``_pv{i}`` columns: validation text of every path the rules read."""
    if meta_paths is None:
        meta_paths = metadata_paths(rules)
    paths = rules.doc_paths(meta_paths)
    df = P.add_path_texts(executions, doc, paths, prefix="_pv")
    cols = {p: f"_pv{i}" for i, p in enumerate(paths)}
    proc_paths = sorted({p for p in meta_paths if p.startswith(PROCESSOR_PREFIX)}
                        | {p for lst in rules.meta_paths.values() for _, p in lst if p.startswith(PROCESSOR_PREFIX)})
    if rules.processor is not None and proc_paths:
        key_path = rules.path_of(PROCESSOR_KEY_FIELD)
        raw = F.col(cols[key_path]) if key_path in cols else F.lit("")
        cpu = T.normalize_value(raw, F.lit(rules.types.get(PROCESSOR_KEY_FIELD) == T.INTEGER))
        if "proc" not in rules.extra:
            rules.extra["proc"] = sized_broadcast(rules.processor)
        proc = rules.extra["proc"]
        df = df.withColumn("_cpu", cpu).join(proc, F.col("_cpu") == proc["_proc_key"], "left")
        for j, p in enumerate(proc_paths):
            df = df.withColumn(f"_pp{j}", F.coalesce(F.col("_proc_attrs")[F.lit(p[len(PROCESSOR_PREFIX):])],
                                                     F.lit("")))
            cols[p] = f"_pp{j}"
        df = df.drop("_cpu", "_proc_key", "_proc_attrs")
    return df, Values(cols)


def _applicable(rules: RuleSet, field: str, vals: Values) -> Column:
    cond = F.lit(True)
    for f, path, op, value in rules.conditional:
        if f != field:
            continue
        got = F.lower(vals.get(path))
        if op == "equals":
            cond = cond & (got == F.lit(value))
        elif op == "not_equals":
            cond = cond & (got != F.lit(value))
    return cond


def validate(rules: RuleSet, executions: DataFrame, doc: Column, id_col: str = "exec_id",
             meta_paths: list[str] | None = None) -> DataFrame:
    """Returns executions with isValid, invalidPayload, fieldStatus and invalid_names.

    Also keeps, per primary field i, ``_f{i}`` = struct(value, status, applicable, empty)
    for the long-form reports.
    """
    tmap = types_map_col(rules.types)
    pairs = metadata_pairs(rules)
    if meta_paths is None:
        meta_paths = sorted({p for _, p in pairs if p})
    df, vals = with_values(rules, executions, doc, meta_paths)
    # observed value of every (metadata name, path) pair, normalised by the name's type, computed once per row
    mcols, mv = [], []
    for j, (n, p) in enumerate(pairs):
        v = T.normalize_value(vals.get(p), F.lit(rules.types.get(n) == T.INTEGER))
        mcols += [v.alias(f"_mvv{j}"), T.default_process(v).alias(f"_mvp{j}")]
        mv.append(F.struct(F.col(f"_mvv{j}").alias("value"), F.col(f"_mvp{j}").alias("proc"),
                           T.is_empty(F.col(f"_mvv{j}")).alias("empty")))
    df = df.select("*", *mcols)
    pair_col = {pr: f"_mvv{j}" for j, pr in enumerate(pairs)}
    df = df.withColumn("_mv", F.array(*mv) if mv else F.array().cast("array<struct<value:string,proc:string,empty:boolean>>"))
    entries, statuses, longs = [], [], []
    for i, m in enumerate(rules.primary_fields):
        value = T.normalize_value(vals.get(m.path), F.lit(rules.types.get(m.field) == T.INTEGER))
        df = df.withColumn(f"_val{i}", value)
        key = ("cfg", m.field)
        if key not in rules.extra:  # the size check runs once per rule set (not per micro-batch)
            rules.extra[key] = sized_broadcast(rules.configs.where(F.col("field") == m.field)
                                               .withColumn("cfgs", _placed("cfgs", pairs)))
        cfg = rules.extra[key].select(F.col("value").alias(f"_hit{i}"), F.col("cfgs").alias(f"_cfgs{i}"))
        df = df.join(cfg, F.col(f"_val{i}") == F.col(f"_hit{i}"), "left")
        v = F.col(f"_val{i}")
        df = df.withColumn(f"_app{i}", _applicable(rules, m.field, vals))
        applicable = F.col(f"_app{i}")
        empty = T.is_empty(v)
        prim_invalid = applicable & (empty | F.col(f"_hit{i}").isNull())
        valid_branch = applicable & ~prim_invalid

        def req_eval(r: Column) -> Column:
            return let(F.get(F.col("_mv"), r["at"]), lambda o: F.struct(
                r["name"].alias("name"), o["value"].alias("value"),
                F.when(o["empty"] | (o["proc"] != r["required_proc"]),
                       F.lit("invalid")).otherwise(F.lit("valid")).alias("validation_status"),
                r["path"].alias("mapping")))

        def eval_cfg(c: Column) -> Column:
            return let(F.transform(c["reqs"], req_eval), lambda metas: F.struct(
                F.size(F.filter(metas, lambda x: x["validation_status"] == "invalid")).alias("errors"),
                c["ordinal"].alias("ordinal"), c["ml_id"].alias("ml_id"), metas.alias("metas")))

        best = F.array_min(F.transform(F.col(f"_cfgs{i}"), eval_cfg))
        inv_list = rules.meta_paths.get(m.field, [])
        if inv_list:
            inv_meta = F.array(*[F.struct(F.lit(n).alias("name"),
                                          F.col(pair_col[(n, p)]).alias("value"),
                                          F.lit("invalid").alias("validation_status"),
                                          F.lit(p).alias("mapping")) for n, p in inv_list])
        else:
            inv_meta = empty_meta()
        df = df.withColumn(f"_best{i}", F.when(valid_branch, best))
        mismatch = valid_branch & (F.col(f"_best{i}.errors") > 0)
        overall_invalid = prim_invalid | mismatch
        metadata = (F.when(valid_branch, F.coalesce(F.col(f"_best{i}.metas"), empty_meta()))
                    .when(prim_invalid & ~empty, inv_meta)
                    .otherwise(empty_meta()))
        status = F.when(prim_invalid, F.lit("invalid")).otherwise(F.lit("valid"))
        entries.append(F.when(overall_invalid, F.struct(
            F.lit(m.field).alias("field"), v.alias("value"), status.alias("validation_status"),
            F.lit(m.path).alias("mapping"), metadata.alias("metadata"))))
        statuses += [F.lit(m.field), status]
        longs.append(F.struct(F.lit(m.field).alias("field"), v.alias("value"), status.alias("status"),
                              applicable.alias("applicable"), empty.alias("empty"),
                              F.col(f"_best{i}.ml_id").alias("best_ml_id"),
                              F.col(f"_best{i}.ordinal").alias("best_ordinal"),
                              F.col(f"_best{i}.errors").alias("best_errors")))
    if entries:
        payload = F.filter(F.array(*entries), lambda e: e.isNotNull())
        field_status = F.create_map(*statuses)
        fields_long = F.array(*longs)
    else:
        payload = F.array().cast(f"array<struct<field:string,value:string,validation_status:string,"
                                 f"mapping:string,metadata:array<{META_T}>>>")
        field_status = F.create_map().cast("map<string,string>")
        fields_long = F.array()
    out = (df.withColumn("invalidPayload", payload)
           .withColumn("fieldStatus", field_status)
           .withColumn("_fields", fields_long))
    names = F.array_sort(F.array_distinct(F.concat(
        F.transform(F.filter("invalidPayload", lambda e: e["validation_status"] == "invalid"), lambda e: e["field"]),
        F.flatten(F.transform("invalidPayload", lambda e: F.transform(
            F.filter(e["metadata"], lambda x: x["validation_status"] == "invalid"), lambda x: x["name"]))))))
    out = (out.withColumn("isValid", F.size("invalidPayload") == 0)
           .withColumn("invalid_names", names))
    drop = [c for c in out.columns if c.startswith("_") and c != "_fields"]
    return out.drop(*drop)


def field_values(rules: RuleSet, executions: DataFrame, doc: Column, id_col: str = "exec_id") -> DataFrame:
    """Long table (exec_id, field, path, value) for every mapped field, values normalised (V2)."""
    tmap = types_map_col(rules.types)
    paths = [m.path for m in rules.mappings if m.path]
    df = P.add_path_texts(executions.select(id_col, doc.alias("_doc0")), F.col("_doc0"), paths, prefix="_fv")
    items = []
    for m in rules.mappings:
        raw = F.col(f"_fv{paths.index(m.path)}") if m.path else F.lit("")
        items.append(F.struct(F.lit(m.field).alias("field"), F.lit(m.path).alias("path"),
                              T.normalize_value(raw, is_integer_field(tmap, F.lit(m.field))).alias("value")))
    return df.select(id_col, F.inline(F.array(*items)))


def payload_flat(validated: DataFrame, id_col: str = "exec_id") -> DataFrame:
    """V8 flattened: one row per (execution, invalid field, metadata position)."""
    e = validated.select(id_col, F.posexplode("invalidPayload").alias("field_pos", "e"))
    return e.select(id_col, "field_pos", F.col("e.field").alias("field"), F.col("e.value").alias("value"),
                    F.col("e.validation_status").alias("validation_status"), F.col("e.mapping").alias("mapping"),
                    F.posexplode_outer("e.metadata").alias("meta_pos", "m")).select(
        id_col, "field", "value", "validation_status", "mapping", "meta_pos",
        F.col("m.name").alias("meta_name"), F.col("m.value").alias("meta_value"),
        F.col("m.validation_status").alias("meta_status"), F.col("m.mapping").alias("meta_mapping"))


def primary_status(validated: DataFrame, id_col: str = "exec_id") -> DataFrame:
    """V4/V9 long form: (exec_id, field, value, status, applicable, empty, best_ordinal, best_errors)."""
    return validated.select(id_col, F.inline("_fields"))


def totals(validated: DataFrame) -> DataFrame:
    """Valid / invalid / processed counts."""
    return validated.agg(F.count_if(F.col("isValid")).alias("valid"),
                         F.count_if(~F.col("isValid")).alias("invalid"),
                         F.count(F.lit(1)).alias("processed"))
