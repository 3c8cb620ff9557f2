"""Rule discovery from the published masterlist (mappings, field types, rule tables).

Rule tables stay DataFrames.  Only rule *metadata* -- the list of mapped
fields and paths and their inferred type (one row per field) -- is brought to
the driver to shape the validation plan, with an explicit size bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.functions import paths as P
from hygeia.functions import text as T

# Conditional applicability rules (fixed values): field -> (condition path, op, value)
DEFAULT_CONDITIONAL_RULES = [
    ("instanceType", "sutInstanceMetadata.sutType", "equals", "cloud"),
]
PROCESSOR_PREFIX = "processor_details."
# the document field whose value keys the processor dimension (fixed value)
PROCESSOR_KEY_FIELD = "CPUModel"
MAX_RULE_FIELDS = 10_000

CONDITIONAL_SCHEMA = "field string, cond_path string, op string, value string"


@dataclass
class Mapping:
    field: str
    path: str          # path used for extraction ("" for a metadata name seen before its mapping_)
    resolved: str      # path used for type inference (empty paths filled from mapping_<name>)
    primary: bool      # a Published masterlist type -> validated at top level
    order: int


@dataclass
class RuleSet:
    mappings: list[Mapping]
    types: dict[str, str]
    conditional: list[tuple[str, str, str, str]]
    records: DataFrame          # Published records in mapped types, normalised, with reqs
    values: DataFrame           # (field, value, ml_id, ordinal)            valid value sets
    configs: DataFrame          # (field, value, cfgs)                      candidate configurations
    meta_paths: dict[str, list[tuple[str, str]]]  # type -> [(metadata name, path)] in first-seen order
    signatures: DataFrame       # (field, ordinal, ml_id, primary_value, metadata, signature)
    meta_values: DataFrame      # (name, value, ml_id)
    processor: DataFrame | None  # (_proc_key, _proc_attrs map)
    extra: dict = dc_field(default_factory=dict)

    @property
    def primary_fields(self) -> list[Mapping]:
        return [m for m in self.mappings if m.primary]

    def path_of(self, name: str) -> str:
        for m in self.mappings:
            if m.field == name:
                return m.path
        return ""

    def doc_paths(self, metadata_paths: list[str]) -> list[str]:
        """Every document path the validation plan reads (processor paths excluded)."""
        ps = [m.path for m in self.mappings if m.primary and m.path]
        ps += [c[1] for c in self.conditional]
        ps += metadata_paths
        ps += [p for lst in self.meta_paths.values() for _, p in lst]
        out = []
        for p in ps:
            if p and not p.startswith(PROCESSOR_PREFIX) and p not in out:
                out.append(p)
        return out


def published(masterlist: DataFrame) -> DataFrame:
    """S1 + P8: Published records, canonical type names, null types dropped."""
    return (masterlist.where(F.col("status") == "Published")
            .withColumn("type", T.canon_type_name(F.col("type")))
            .where(F.col("type").isNotNull()))


def primary_mappings(pub: DataFrame) -> DataFrame:
    """First mapping per type by ordinal; types whose first mapping is empty are skipped."""
    return (pub.groupBy("type")
            .agg(F.min_by(F.col("data.mapping"), F.col("ordinal")).alias("path"),
                 F.min("ordinal").alias("f_ord"))
            .where(F.col("path").isNotNull() & (F.col("path") != ""))
            .select(F.col("type").alias("field"), "path", "f_ord"))


def metadata_entries(pub: DataFrame) -> DataFrame:
    """Every (record, position, key, value) of data.metadata, in map order."""
    return (pub.where(F.col("data.metadata").isNotNull())
            .select("ordinal", F.posexplode("data.metadata").alias("pos", "k", "v")))


def metadata_mappings(pub: DataFrame, prim: DataFrame) -> DataFrame:
    """Metadata names (incl. mapping_* twins) not already types; first occurrence wins."""
    e = metadata_entries(pub)
    is_map = F.col("k").startswith("mapping_")
    named = e.select(
        T.canon_param_name(F.replace(F.col("k"), F.lit("mapping_"), F.lit(""))).alias("field"),
        F.when(is_map, F.coalesce(F.col("v"), F.lit("None"))).otherwise(F.lit("")).alias("path"),
        F.struct("ordinal", "pos").alias("o"))
    first = named.groupBy("field").agg(F.min_by("path", "o").alias("path"), F.min("o").alias("o"))
    return (first.join(prim.select("field"), "field", "left_anti")
            .select("field", "path", F.col("o.ordinal").alias("f_ord"), F.col("o.pos").alias("f_pos")))


def mapping_fill(pub: DataFrame) -> DataFrame:
    """First non-empty ``mapping_<name>`` path per name (case-insensitive, deviation D17)."""
    e = metadata_entries(pub).where(F.col("k").startswith("mapping_") & (F.col("v") != ""))
    return (e.groupBy(F.lower(F.replace(F.col("k"), F.lit("mapping_"), F.lit(""))).alias("lname"))
            .agg(F.min_by("v", F.struct("ordinal", "pos")).alias("fill")))


def type_counts(executions: DataFrame, doc: Column, paths: list[str]) -> dict[str, tuple[int, int]]:
    """V1: path -> (non-empty values, of these not integers). Counts of parts of a table add up to those of the whole.

    One aggregate over the given rows (no sample limit, deviation D3); only the mapped paths are extracted.  One small
    row reaches the driver.
    """
    paths = list(dict.fromkeys(paths))
    if not paths:
        return {}
    df = P.add_path_texts(executions.select(doc.alias("_doc0")), F.col("_doc0"), paths, prefix="_it", infer=True)
    aggs = []
    for i in range(len(paths)):
        t = F.col(f"_it{i}")
        nonempty = t.isNotNull() & (t != "") & ~F.lower(t).isin(*T.INFER_IGNORED)
        aggs.append(F.sum(F.when(nonempty, 1).otherwise(0)).alias(f"n{i}"))
        aggs.append(F.sum(F.when(nonempty & ~T.is_int_text(t), 1).otherwise(0)).alias(f"bad{i}"))
    row = df.agg(*aggs).first()
    return {p: (row[f"n{i}"] or 0, row[f"bad{i}"] or 0) for i, p in enumerate(paths)}


def types_of_counts(fields: list[tuple[str, str]], counts: dict[str, tuple[int, int]]) -> dict[str, str]:
    """INTEGER iff at least one non-empty value and every non-empty value parses as int."""
    out = {}
    for name, path in fields:
        n, bad = counts.get(path, (0, 0))
        out[name] = T.INTEGER if n > 0 and bad == 0 else T.STRING
    return out


def infer_types(executions: DataFrame, doc: Column, fields: list[tuple[str, str]]) -> dict[str, str]:
    """V1 over the whole execution table."""
    return types_of_counts(fields, type_counts(executions, doc, [p for _, p in fields]))


def types_map_col(types: dict[str, str]) -> Column:
    if not types:
        return F.create_map().cast("map<string,string>")
    kv = []
    for k, v in sorted(types.items()):
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def is_integer_field(types: Column, name: Column) -> Column:
    return F.coalesce(types[name] == F.lit(T.INTEGER), F.lit(False))


def _bounded(df: DataFrame, order: list[str]) -> list:
    """All rows of a table of rule metadata; more than a plan can hold is an error, never a cut."""
    rows = df.orderBy(*order).limit(MAX_RULE_FIELDS + 1).collect()
    if len(rows) > MAX_RULE_FIELDS:
        raise ValueError(f"more than {MAX_RULE_FIELDS} mapped fields or metadata paths for one validation plan")
    return rows


def build_rules(masterlist: DataFrame, executions: DataFrame | None, doc: Column | None,
                processor_details: DataFrame | None = None,
                processor_key: str = "cpuModelNo",
                conditional: list[tuple[str, str, str, str]] | None = None,
                counts_for: Callable[[list[str]], dict[str, tuple[int, int]]] | None = None) -> RuleSet:
    """Derive every rule table from the masterlist (and field types from the executions, or from ``counts_for(paths)``,
    kept counts as of ``type_counts``: then no execution is read)."""
    conditional = DEFAULT_CONDITIONAL_RULES if conditional is None else conditional
    pub = published(masterlist).select("ordinal", "ml_id", "type", "data")
    prim = primary_mappings(pub)
    meta = metadata_mappings(pub, prim)
    # one row per mapped field: each becomes a column of the validation plan
    types_of = pub.select("type").distinct().withColumn("_primary", F.lit(True))
    prim_rows = _bounded(prim.join(types_of, F.col("field") == F.col("type"), "left")
                         .select("field", "path", "f_ord", F.coalesce("_primary", F.lit(False)).alias("primary")), ["f_ord"])
    meta_rows = _bounded(meta.join(mapping_fill(pub), F.lower("field") == F.col("lname"), "left")
                         .join(types_of, F.col("field") == F.col("type"), "left")
                         .select("field", "path", "f_ord", "f_pos", "fill", F.coalesce("_primary", F.lit(False)).alias("primary")),
                         ["f_ord", "f_pos"])

    mappings: list[Mapping] = []
    for i, r in enumerate(prim_rows):
        mappings.append(Mapping(r["field"], r["path"], r["path"], r["primary"], i))
    for j, r in enumerate(meta_rows):
        mappings.append(Mapping(r["field"], r["path"], r["path"] or r["fill"] or "", r["primary"], len(prim_rows) + j))

    scan = [(m.field, m.resolved) for m in mappings
            if m.resolved and not m.resolved.startswith(PROCESSOR_PREFIX)]
    types = {m.field: T.STRING for m in mappings}
    if counts_for is None:
        types.update(infer_types(executions, doc, scan))
    else:
        types.update(types_of_counts(scan, counts_for(list(dict.fromkeys(p for _, p in scan)))))
    tmap = types_map_col(types)
    mapped = [m.field for m in mappings]

    # Published records of mapped types, normalised value and metadata requirements.
    m = F.col("data.metadata")
    keys = F.filter(F.array_sort(F.coalesce(F.map_keys(m), F.array().cast("array<string>"))),
                    lambda k: ~k.startswith("mapping_") & (k != "mapping")
                    & F.coalesce(T.py_strip(m[k]) != "", F.lit(False)))

    def req(k: Column) -> Column:
        own = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == F.lower(F.concat(F.lit("mapping_"), k)))
        own_path = F.get(own, 0)["value"]
        path = F.when(F.coalesce(own_path, F.lit("")) != "", own_path).otherwise(F.coalesce(m["mapping"], F.lit("")))
        required = T.normalize_value(T.py_strip(m[k]), is_integer_field(tmap, k))
        return F.struct(k.alias("name"), path.alias("path"), required.alias("required"),
                        T.default_process(required).alias("required_proc"))

    val = F.coalesce(T.py_strip(F.col("data.value")), F.lit(""))
    records = (pub.where(F.col("type").isin(*mapped))
               .select("ordinal", "ml_id", F.col("type").alias("field"),
                       T.normalize_value(val, is_integer_field(tmap, F.col("type"))).alias("value"),
                       F.transform(keys, req).alias("reqs")))

    with_val = records.where(F.col("value") != "")
    values = (with_val.groupBy("field", "value")
              .agg(F.max_by("ml_id", "ordinal").alias("ml_id"), F.min("ordinal").alias("ordinal")))
    # Configurations of one value that require exactly the same metadata are
    # interchangeable except for order, so only the earliest one is kept; the
    # per-value list is then bounded by distinct requirement sets.
    configs = (with_val.groupBy("field", "value", "reqs")
               .agg(F.min_by("ml_id", "ordinal").alias("ml_id"), F.min("ordinal").alias("ordinal"))
               .groupBy("field", "value")
               .agg(F.array_sort(F.collect_list(F.struct("ordinal", "ml_id", "reqs"))).alias("cfgs")))

    req_rows = records.select("ordinal", "ml_id", "field", F.explode("reqs").alias("r"))
    mp = _bounded(req_rows.where(F.col("r.path") != "")
                  .groupBy("field", F.col("r.name").alias("name"))
                  .agg(F.max_by("r.path", "ordinal").alias("path"), F.min("ordinal").alias("first")),
                  ["field", "first", "name"])
    meta_paths: dict[str, list[tuple[str, str]]] = {}
    for r in mp:
        meta_paths.setdefault(r["field"], []).append((r["name"], r["path"]))

    signatures = with_val.select(
        "field", "ordinal", "ml_id", F.col("value").alias("primary_value"),
        F.map_from_entries(F.transform("reqs", lambda r: F.struct(r["name"], r["required"]))).alias("metadata"),
        T.signature(F.concat(F.array("value"), F.transform("reqs", lambda r: r["required"]))).alias("signature"))

    meta_values = (req_rows.groupBy(F.col("r.name").alias("name"), F.col("r.required").alias("value"))
                   .agg(F.max_by("ml_id", "ordinal").alias("ml_id")))

    proc = None
    if processor_details is not None:
        proc = processor_dimension(processor_details, processor_key)

    return RuleSet(mappings=mappings, types=types, conditional=list(conditional), records=records,
                   values=values, configs=configs, meta_paths=meta_paths, signatures=signatures,
                   meta_values=meta_values, processor=proc)


def processor_dimension(proc: DataFrame, key: str = "cpuModelNo") -> DataFrame:
    """Dimension keyed by the text of ``key`` (falsy keys skipped, last row wins)."""
    attrs = [c for c in proc.columns if c not in ("ordinal",)]
    kv = []
    for c in attrs:
        kv += [F.lit(c), F.coalesce(T.py_strip(F.col(f"`{c}`").cast("string")), F.lit(""))]
    k = F.col(f"`{key}`").cast("string")
    order = F.col("ordinal") if "ordinal" in proc.columns else F.monotonically_increasing_id()
    return (proc.where(k.isNotNull() & (k != ""))
            .select(k.alias("_proc_key"), F.create_map(*kv).alias("_proc_attrs"), order.alias("_o"))
            .groupBy("_proc_key").agg(F.max_by("_proc_attrs", "_o").alias("_proc_attrs")))


def metadata_schema(masterlist: DataFrame, type_name: str) -> DataFrame:
    """Metadata names of a representative Published record of a type (exact type first,
    then case-insensitive): non-mapping metadata keys, plus top-level data keys that have a
    ``mapping_`` twin (resolved from the data struct's schema)."""
    pub = masterlist.where(F.col("status") == "Published")
    cand = (pub.where(F.lower("type") == type_name.lower())
            .select(F.when(F.col("type") == type_name, 0).otherwise(1).alias("pri"), "ordinal", "data"))
    rep = cand.groupBy().agg(F.min_by("data", F.struct("pri", "ordinal")).alias("data"))
    keys = F.filter(F.coalesce(F.map_keys("data.metadata"), F.array().cast("array<string>")),
                    lambda k: ~k.startswith("mapping") & (k != "value"))
    data_fields = [f.name for f in masterlist.schema["data"].dataType.fields]
    twins = [f for f in data_fields if f"mapping_{f}" in data_fields]
    top = [F.when(F.col(f"data.{f}").isNotNull() | F.col(f"data.mapping_{f}").isNotNull(), F.lit(f))
           for f in twins]
    names = F.concat(keys, F.filter(F.array(*top), lambda x: x.isNotNull())) if top else keys
    return rep.select(F.explode(F.array_sort(F.array_distinct(names))).alias("name"))


def valid_values_and_paths(rules: RuleSet) -> DataFrame:
    """P25: per type its valid values and its metadata paths, as one long table
    (field, kind, name, value) -- no per-type collection into one row."""
    spark = rules.values.sparkSession
    mp = spark.createDataFrame([(t, "meta_path", n, p) for t, lst in rules.meta_paths.items() for n, p in lst],
                               "field string, kind string, name string, value string")
    vals = rules.values.select("field", F.lit("value").alias("kind"), F.lit(None).cast("string").alias("name"),
                               "value")
    return vals.unionByName(mp)
