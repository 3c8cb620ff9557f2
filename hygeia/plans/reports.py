"""Reports (R1-R9) and their aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.operators.paging import KeyIndex, key_index


def first_per_key(df: DataFrame, key: str, order: Column | None = None, cols: list[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order`` (deterministic, deviation D8)."""
    cols = cols or [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in cols])
    first = F.min(packed) if order is None else F.min_by(packed, order)  # without an order: the least row
    return (df.groupBy(key).agg(first.alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def validation_counts(validated: DataFrame, fields: list[str], id_col: str = "exec_id",
                      dedupe: bool = True) -> DataFrame:
    """Per mapped field, documents where it is invalid vs the rest; one shared aggregate.

    Executions are first reduced to one row per id (A1).  The per-field counts
    are a single grouped aggregate over the exploded invalid names (partial
    aggregation map-side, a handful of groups).
    """
    docs = validated.select(id_col, "invalid_names")
    if dedupe:
        docs = first_per_key(docs, id_col)
    total = docs.select(F.count(F.lit(1))).scalar()  # uncorrelated scalar subquery
    inv = (docs.select(F.explode("invalid_names").alias("field"))
           .groupBy("field").agg(F.count(F.lit(1)).alias("invalid")))
    spark = validated.sparkSession
    fdf = spark.createDataFrame([(f,) for f in fields], "field string")
    return (fdf.join(inv, "field", "left")
            .select("field", (total - F.coalesce("invalid", F.lit(0))).alias("valid"),
                    F.coalesce("invalid", F.lit(0)).alias("invalid"), total.alias("total")))


AGE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
DEFAULT_STATUSES = ["PENDING", "REJECTED", "ON HOLD", "ACCEPTED"]
BUCKETS = ["green", "yellow", "red"]


def _age_bucket(ts: Column, as_of: str) -> Column:
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / F.lit(86400e6)
    return F.when(days < 3, F.lit("green")).when(days <= 6, F.lit("yellow")).otherwise(F.lit("red"))


def _bucket_counts(df: DataFrame, bucket: Column) -> DataFrame:
    spark = df.sparkSession
    got = df.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    fixed = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return fixed.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ageing_pending(snapshots: DataFrame, as_of: str) -> DataFrame:
    """A5/R2: PENDING (first element, any case) snapshots by age of history.updatedOn.

    Missing / empty timestamps are skipped; text that does not parse with the
    fixed format counts as yellow.  ``as_of`` replaces the wall clock.
    """
    d0 = F.get(F.col("data"), 0)
    s = snapshots.where(F.upper(d0["standardization_status"]) == "PENDING") \
        .select(d0["history"]["updatedOn"].alias("u")).where(F.col("u").isNotNull() & (F.col("u") != ""))
    ts = F.try_to_timestamp(F.col("u"), F.lit(AGE_FORMAT))
    return _bucket_counts(s, F.when(ts.isNull(), F.lit("yellow")).otherwise(_age_bucket(ts, as_of)))


def status_filter(statuses: list[str] | None = None) -> Column:
    """Any data element whose status equals one of the list (case-insensitive)."""
    wanted = [x.strip().upper() for x in (statuses or DEFAULT_STATUSES) if x.strip()]
    return F.exists(F.col("data"), lambda d: F.upper(d["standardization_status"]).isin(*wanted))


def ageing_filtered(snapshots: DataFrame, as_of: str, cond: Column | None = None) -> DataFrame:
    """Same buckets over a filtered set; first non-missing updatedOn; unparseable dropped."""
    cond = status_filter() if cond is None else cond
    first = F.get(F.filter(F.transform("data", lambda d: d["history"]["updatedOn"]), lambda u: u.isNotNull()), 0)
    ts = first.try_cast("timestamp")
    s = snapshots.where(cond).select(ts.alias("ts")).where(F.col("ts").isNotNull())
    return _bucket_counts(s, _age_bucket(F.col("ts"), as_of))


def search_filter(term: str | None, cols: list[str], resolved: dict[str, str] | None = None,
                  literal: bool = False) -> Column:
    """Case-insensitive regex on the id / type / category columns, or equality with a
    fuzzy-resolved term (J14 result) for the columns that have one."""
    if not term:
        return F.lit(True)
    pat = term if not literal else "\\Q" + term + "\\E"
    cond = F.lit(False)
    for c in cols:
        if resolved and c in resolved:
            cond = cond | (F.col(c) == F.lit(resolved[c]))
        else:
            cond = cond | F.col(c).cast("string").rlike("(?i)" + pat)
    return cond


def page(df: DataFrame, order: list[Column], page_no: int = 1, size: int = 50) -> DataFrame:
    """Sort, skip (page-1)*size, take size (1..500)."""
    if not 1 <= size <= 500 or page_no < 1:
        raise ValueError("a page has 1 to 500 rows and pages count from 1")
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def resolve_search(masterlist: DataFrame, term: str, type_col: str, category_col: str, cutoff: float = 60) -> dict[str, str]:
    """P16 with J14: the published benchmark type and category that a search term means, by column; a column whose values
    are all unlike the term is left out (it is searched by the expression itself).  One row a column reaches the driver."""
    from hygeia.plans.suggest import resolve_term
    best = resolve_term(masterlist.where(F.col("status") == "Published"), term, {
        type_col: (["Benchmark"], "metadata:BenchmarkType"), category_col: (["Benchmark"], "value")}, cutoff)
    return {r["name"]: r["resolved"] for r in best.where("is_fuzzy").collect()}


def _invalid_records(validated: DataFrame, valid: bool, search: str | None, id_col: str,
                     resolved: dict[str, str] | None = None) -> DataFrame:
    base = validated.where(F.col("isValid") == F.lit(valid)).where(
        search_filter(search, [id_col, "benchmarkType", "benchmarkCategory"], resolved))
    return first_per_key(base.select(id_col, "invalid_names", "benchmarkType", "benchmarkCategory"), id_col)


def _record_columns(p: DataFrame, status: str, total: Column, id_col: str) -> DataFrame:
    return p.select(F.col(id_col).cast("string").alias("execution_id"), F.lit(status).alias("status"),
                    F.col("benchmarkType").alias("benchmark_type"),
                    F.col("benchmarkCategory").alias("benchmark_category"),
                    F.array_join("invalid_names", ",").alias("invalid_fields"), total.alias("total"))


def invalid_records_page(validated: DataFrame, status: str = "PENDING", search: str | None = None,
                         page_no: int = 1, size: int = 50, id_col: str = "exec_id",
                         resolved: dict[str, str] | None = None) -> DataFrame:
    """Executions by validity (P14), one per id (A1), paged by id desc (T1), with the total (A2).
    ``resolved`` (``resolve_search``) has the columns whose value the search term means."""
    st = (status or "PENDING").upper()
    if st not in ("PENDING", "ACCEPTED", "REJECTED"):
        return validated.sparkSession.createDataFrame(
            [], "execution_id string, status string, benchmark_type string, benchmark_category string, "
                "invalid_fields string, total bigint")
    firsts = _invalid_records(validated, st == "ACCEPTED", search, id_col, resolved)
    total = firsts.select(F.count(F.lit(1))).scalar()
    return _record_columns(page(firsts, [F.desc(id_col)], page_no, size), st, total, id_col)


def payload_details(records: DataFrame, validated: DataFrame, id_col: str = "exec_id") -> DataFrame:
    """R1, details of PENDING records: rows of a page with the payload of the execution that each shows.

    The page is cut first; payloads are looked up for its rows only.  Of rows that repeat an id the page shows the least
    (names, type, category), so the payload is the least of those rows."""
    keys = records.select(F.col("execution_id").alias("_id"), F.col("invalid_fields").alias("_f"),
                          F.col("benchmark_type").alias("_t"), F.col("benchmark_category").alias("_c"))
    v = validated.where(~F.col("isValid"))
    hit = v.join(F.broadcast(keys), (v[id_col].cast("string") == F.col("_id")) & (F.array_join("invalid_names", ",") == F.col("_f"))
                 & v["benchmarkType"].eqNullSafe(F.col("_t")) & v["benchmarkCategory"].eqNullSafe(F.col("_c")))  # a page: at most 500 rows
    found = hit.groupBy(F.col("_id").alias("execution_id")).agg(F.min("invalidPayload").alias("details"))
    pending = F.when(F.col("status") == "PENDING", F.col("details"))
    return records.join(found, "execution_id", "left").withColumn("details", pending)


def invalid_records_index(validated: DataFrame, valid: bool = False, search: str | None = None, id_col: str = "exec_id",
                          rows_per_range: int = 100_000) -> KeyIndex:
    """The rows of ``invalid_records_page`` in key ranges, for reading many or late pages."""
    return key_index(_invalid_records(validated, valid, search, id_col), [id_col], rows_per_range)


def invalid_records_at(index: KeyIndex, page_no: int, size: int = 50, status: str = "PENDING") -> DataFrame:
    """``invalid_records_page`` read from its index."""
    return _record_columns(index.page(page_no, size), status, F.lit(index.total).cast("bigint"), index.keys[0])


def invalid_summary(snapshots: DataFrame, executions: DataFrame, statuses: list[str] | None = None,
                    search: str | None = None, page_no: int = 1, size: int = 50,
                    exec_id: str = "exec_id", resolved: dict[str, str] | None = None, as_of: str | None = None) -> DataFrame:
    """Snapshot page (P15, P16, T1) joined to executions after paging (J6), P18 fallbacks,
    invalid field names (V12) and the filtered total (A9).  With ``as_of`` every row also has the counts by age:
    of the same filter (A6), or without search and statuses those of all pending snapshots (A5)."""
    cond = status_filter(statuses) & search_filter(search, ["execution_id", "benchmark_type", "benchmark_category"], resolved)
    m = snapshots.where(cond)
    total = m.select(F.count(F.lit(1))).scalar()
    p = page(m, [F.desc("snapshot_id")], page_no, size)
    ex = executions.select(F.col(exec_id).cast("string").alias("_eid"),
                           F.col("benchmarkType").alias("_ebt"), F.col("benchmarkCategory").alias("_ebc"),
                           F.lit(True).alias("_hit"))
    ex = ex.join(p.select(F.col("execution_id").alias("_eid")).distinct(), "_eid", "left_semi")
    j = p.join(ex, p["execution_id"] == ex["_eid"], "left")
    d0 = F.get(F.col("data"), 0)
    names = F.array_sort(F.array_distinct(F.concat(
        F.transform(F.filter(d0["invalidValues"], lambda v: v["validation_status"] == "invalid"), lambda v: v["field"]),
        F.flatten(F.transform(d0["invalidValues"], lambda v: F.transform(
            F.filter(v["metadata"], lambda x: x["validation_status"] == "invalid"), lambda x: x["name"]))))))
    fb = lambda a, e: F.coalesce(F.nullif(F.col(a), F.lit("")),
                                 F.when(F.col("_hit"), F.col(e)).otherwise(F.lit("N/A")))
    return j.select("execution_id", d0["standardization_status"].alias("status"),
                    fb("benchmark_type", "_ebt").alias("benchmark_type"),
                    fb("benchmark_category", "_ebc").alias("benchmark_category"),
                    F.array_join(F.coalesce(names, F.array().cast("array<string>")), ",").alias("invalid_fields"),
                    d0["history"]["updatedOn"].alias("updated_on"), total.alias("total"), *_ageing(snapshots, cond, bool(search or statuses), as_of))


def _ageing(snapshots: DataFrame, cond: Column, filtered: bool, as_of: str | None) -> list[Column]:
    if as_of is None:
        return []
    counts = ageing_filtered(snapshots, as_of, cond) if filtered else ageing_pending(snapshots, as_of)
    return [counts.where(F.col("bucket") == b).select("n").scalar().alias(b) for b in BUCKETS]


#: Other names of parameters (fixed values).
ALIASES = {"BenchmarkCategory": "Benchmark"}


def unique_values(masterlist: DataFrame, params: list[str]) -> DataFrame:
    """Distinct stripped text per parameter (types: data.value of that type; metadata
    names: data.metadata[name] over all Published records), sorted; 'BenchmarkCategory' aliases 'Benchmark'."""
    from hygeia.functions.text import py_strip
    pub = masterlist.where(F.col("status") == "Published")
    params = list(params)
    if "Benchmark" in params and "BenchmarkCategory" not in params:
        params.append("BenchmarkCategory")
    spark = masterlist.sparkSession
    pdf = spark.createDataFrame([(p, ALIASES.get(p, p)) for p in params], "param string, qtype string")
    typed = (pub.join(F.broadcast(pdf), pub["type"] == F.col("qtype"))  # one row per asked parameter
             .select("param", py_strip(F.col("data.value")).alias("value")))
    names = pdf.join(pub.select(F.col("type").alias("qtype")).distinct(), "qtype", "left_anti").where(
        ~F.col("param").isin(*ALIASES))
    metas = (pub.select(F.explode("data.metadata").alias("k", "v"))
             .join(F.broadcast(names), F.col("k") == F.col("param"))
             .select("param", py_strip(F.col("v")).alias("value")))
    return typed.unionByName(metas).where(F.col("value").isNotNull()).distinct().orderBy("param", "value")  # T5


# Parameters that can be asked for by name -> (type or None for all, metadata name or None for the value)
PARAMETERS = {
    "cpumodel": ("CPUModel", None),
    "instancetype": ("instanceType", None),
    "benchmarktype": ("Benchmark", "BenchmarkType"),
    "benchmarkcategory": ("Benchmark", None),
    "family": (None, "Family"),
    "corecount": (None, "coreCount"),
    "cloudprovider": (None, "cloudProvider"),
}


def parameter_values(masterlist: DataFrame, parameter: str, mapped: list[str], types: list[str]) -> DataFrame:
    """Distinct stripped, non-empty values of one parameter, by its common name or that of a mapped field
    (any case); an unknown name is an error that lists the known ones."""
    from hygeia.functions.text import py_strip
    known = {f.lower(): f for f in mapped}
    name = parameter.lower()
    if name in PARAMETERS:
        of_type, meta = PARAMETERS[name]
    elif name in known:
        of_type, meta = (known[name], None) if known[name] in types else (None, known[name])
    else:
        raise ValueError(f"unknown parameter {parameter!r}; known: {[*PARAMETERS, *mapped]}")
    pub = masterlist.where(F.col("status") == "Published")
    if of_type:
        pub = pub.where(F.col("type") == of_type)
    raw = F.col("data.metadata")[meta] if meta else F.col("data.value")
    return (pub.select(F.lit(parameter).alias("param"), raw.alias("_raw")).where(F.col("_raw").isNotNull() & (F.col("_raw") != ""))
            .select("param", py_strip(F.col("_raw")).alias("value")).distinct().orderBy("value"))


def metadata_values(masterlist: DataFrame, requests: DataFrame, max_records: int | None = None) -> DataFrame:
    """For each requested (type, value), the metadata configurations of its Published records
    (records without metadata dropped); ``max_records`` keeps the first of each, all by default."""
    from hygeia.functions.text import py_strip
    from pyspark.sql import Window
    pub = masterlist.where(F.col("status") == "Published")
    j = pub.join(requests, (pub["type"] == requests["req_type"]) & (F.col("data.value") == requests["req_value"]))
    if max_records is not None:
        w = Window.partitionBy("req_type", "req_value").orderBy("ordinal")
        j = j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_records)
    m = F.col("data.metadata")
    rows = j.select("req_type", "req_value", "ml_id", "ordinal", m.alias("m"),
                    F.explode(F.coalesce(F.map_keys(m), F.array().cast("array<string>"))).alias("mk"))
    rows = rows.where(~F.col("mk").startswith("mapping_") & (F.col("mk") != "mapping"))
    own = F.get(F.filter(F.map_entries("m"), lambda e: F.lower(e["key"]) == F.lower(F.concat(F.lit("mapping_"), F.col("mk")))), 0)["value"]
    path = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.coalesce(F.col("m")["mapping"], F.lit("")))
    return rows.select(F.col("req_type").alias("type"), F.col("req_value").alias("value"), "ml_id",
                       F.col("mk").alias("name"), F.coalesce(py_strip(F.col("m")[F.col("mk")]), F.lit("None")).alias("meta_value"),
                       path.alias("meta_path"))


def snapshot_search(snapshots: DataFrame, executions: DataFrame, term: str, page_no: int = 1, size: int = 50,
                    resolved: dict[str, str] | None = None, exec_id: str = "exec_id") -> DataFrame:
    """Executions matching the term (regex on id / type / category, or the fuzzy-resolved
    value) -> their distinct ids (A12) -> snapshots of those ids (J8, semi-join) -> page by
    snapshot id desc (T1) -> first matching execution per id (J7) -> projection (P20: runCategory, createdOn and
    tester as the executions have them, NULL otherwise, and the snapshot's history).
    A status argument is accepted by the reference but ignored, so there is none here."""
    more = {"runCategory": "run_category", "createdOn": "created_on", "tester": "tester"}
    ex = executions.select(F.col(exec_id).cast("string").alias("execution_id"), "benchmarkType", "benchmarkCategory", *[
        (F.col(c) if c in executions.columns else F.lit(None)).cast("string").alias(n) for c, n in more.items()])
    hits = ex.where(search_filter(term, ["execution_id", "benchmarkType", "benchmarkCategory"], resolved))
    ids = hits.select("execution_id").distinct()
    snaps = snapshots.join(ids, "execution_id", "left_semi")
    total = snaps.select(F.count(F.lit(1))).scalar()
    p = page(snaps, [F.desc("snapshot_id")], page_no, size)
    first = first_per_key(hits.join(p.select("execution_id").distinct(), "execution_id", "left_semi"), "execution_id")
    d0 = F.get(F.col("data"), 0)
    return (p.join(first, "execution_id", "left")
            .select("execution_id", "snapshot_id", d0["standardization_status"].alias("status"),
                    F.coalesce(F.col("benchmark_type"), F.col("benchmarkType")).alias("benchmark_type"),
                    F.coalesce(F.col("benchmark_category"), F.col("benchmarkCategory")).alias("benchmark_category"),
                    *more.values(), d0["history"].alias("history"), total.alias("total")))
