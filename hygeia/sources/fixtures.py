"""Hygiene tables derived from the driver's TPC-H-like parquet tables.

Every view reads whole tables; perturbations are CASE expressions, never
row filters.  The same derivation is written in portable SQL for the DuckDB
oracle (``oracles/fixture.py``).

  masterlist  CPUModel records   = part grouped by (p_name, p_size % 4)
              instanceType       = part grouped by p_type (needs cloudProvider)
              Benchmark          = orders grouped by o_orderpriority x BenchmarkType F/O
  processor   part grouped by p_name -> family = min(p_type)
  executions  orders joined to part on p_partkey = o_orderkey % |part|
  snapshots   one prior review snapshot per order (of the execution with twice its key)
  decisions   events -> review decisions
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Document paths of the fixture (fixed values)
CPU_PATH = "platformProfile.sut.Summary.Server.CPUModel"
CORES_PATH = "platformProfile.sut.Summary.CPU.CPU(s)"
SUT_PATH = "sutInstanceMetadata.sutType"
INSTANCE_PATH = "sutInstanceMetadata.instanceType"
CLOUD_PATH = "sutInstanceMetadata.cloudProvider"
BCAT_PATH = "benchmarkCategory"
BTYPE_PATH = "benchmarkType"
FAMILY_PATH = "processor_details.family"

CPU_OFFSET = 0
INSTANCE_OFFSET = 1_000_000_000_000
BENCH_OFFSET = 2_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masterlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    orders = read(spark, sf_dir, "orders")
    cpu = (part.groupBy("p_name", (F.col("p_size") % 4).alias("b"))
           .agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("family"))
           .select((F.col("k") + CPU_OFFSET).alias("ordinal"),
                   F.concat(F.lit("C"), F.col("k").cast("string")).alias("ml_id"),
                   F.lit("CPUModel").alias("type"),
                   F.when((F.col("b") == 3) & F.col("p_name").startswith("hot "), F.lit("Draft"))
                   .otherwise(F.lit("Published")).alias("status"),
                   F.struct(F.col("p_name").alias("value"), F.lit(CPU_PATH).alias("mapping"),
                            F.create_map(F.lit("mapping_Family"), F.lit(FAMILY_PATH),
                                         F.lit("Family"), F.col("family"),
                                         F.lit("mapping_coreCount"), F.lit(CORES_PATH),
                                         F.lit("coreCount"), ((F.col("b") + 1) * 16).cast("string")
                                         ).alias("metadata")).alias("data")))
    inst = (part.groupBy("p_type").agg(F.min("p_partkey").alias("k"))
            .select((F.col("k") + INSTANCE_OFFSET).alias("ordinal"),
                    F.concat(F.lit("I"), F.col("k").cast("string")).alias("ml_id"),
                    F.lit("instanceType").alias("type"), F.lit("Published").alias("status"),
                    F.struct(F.col("p_type").alias("value"), F.lit(INSTANCE_PATH).alias("mapping"),
                             F.create_map(F.lit("mapping_cloudProvider"), F.lit(CLOUD_PATH),
                                          F.lit("cloudProvider"), F.lit("AWS")).alias("metadata")).alias("data")))
    bench = (orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("k"))
             .select("o_orderpriority", "k", F.inline(F.array(
                 F.struct(F.lit(0).alias("i"), F.lit("F").alias("bt")),
                 F.struct(F.lit(1).alias("i"), F.lit("O").alias("bt")))))
             .select((F.col("k") * 2 + F.col("i") + BENCH_OFFSET).alias("ordinal"),
                     F.concat(F.lit("B"), F.col("k").cast("string"), F.col("bt")).alias("ml_id"),
                     F.lit("Benchmark").alias("type"), F.lit("Published").alias("status"),
                     F.struct(F.col("o_orderpriority").alias("value"), F.lit(BCAT_PATH).alias("mapping"),
                              F.create_map(F.lit("BenchmarkType"), F.col("bt"),
                                           F.lit("mapping_BenchmarkType"), F.lit(BTYPE_PATH)).alias("metadata")
                              ).alias("data")))
    return cpu.unionByName(inst).unionByName(bench)


def processor_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return (part.groupBy("p_name").agg(F.min("p_type").alias("family"), F.min("p_partkey").alias("ordinal"))
            .select(F.col("p_name").alias("cpuModelNo"), "family", "ordinal"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exec_id, doc STRUCT (typed nested document), benchmarkType, benchmarkCategory, createdOn)."""
    part = read(spark, sf_dir, "part")
    orders = read(spark, sf_dir, "orders")
    n_part = part.agg(F.count(F.lit(1))).scalar()  # uncorrelated scalar subquery: |part|
    k = F.col("o_orderkey")
    bucket = ((F.col("p_size") % 4 + 1) * 16)
    cpu = (F.when(k % 9 == 0, F.upper("p_name"))
           .when(k % 9 == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
           .when(k % 9 == 2, F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
           .when(k % 9 == 3, F.lit(""))
           .when(k % 9 == 4, F.lit("nan"))
           .when(k % 9 == 5, F.concat(F.col("p_name"), F.lit(" v2")))
           .otherwise(F.col("p_name")))
    cores = (F.when(k % 11 == 0, (bucket + 1).cast("string"))
             .when(k % 11 == 1, F.concat(F.lit("0"), bucket.cast("string")))
             .when(k % 11 == 2, F.lit(""))
             .otherwise(bucket.cast("string")))
    sut = F.when(k % 3 == 0, F.lit("Cloud")).otherwise(F.lit("server"))
    inst = (F.when(k % 13 == 0, F.lower("p_type")).when(k % 13 == 1, F.lit("")).otherwise(F.col("p_type")))
    cloud = F.when(k % 4 == 0, F.lit("GCP")).when(k % 4 == 1, F.lit("aws")).otherwise(F.lit("AWS"))
    doc = F.struct(
        F.struct(F.struct(F.struct(F.struct(cpu.alias("CPUModel")).alias("Server"),
                                   F.struct(cores.alias("CPU(s)")).alias("CPU")).alias("Summary")).alias("sut")
                 ).alias("platformProfile"),
        F.struct(sut.alias("sutType"), inst.alias("instanceType"), cloud.alias("cloudProvider")
                 ).alias("sutInstanceMetadata"),
        F.col("o_orderpriority").alias("benchmarkCategory"),
        F.col("o_orderstatus").alias("benchmarkType"),
        F.col("o_orderkey").cast("string").alias("benchmarkExecutionID"))
    # a shuffle join: the rows are spread over all tasks whatever the row groups of the file, and no part goes to the driver
    joined = (orders.withColumn("_pk", k % n_part)
              .join(part.hint("merge"), F.col("p_partkey") == F.col("_pk")))
    return joined.select(k.alias("exec_id"), doc.alias("doc"),
                         F.col("o_orderstatus").alias("benchmarkType"),
                         F.col("o_orderpriority").alias("benchmarkCategory"),
                         F.col("o_orderdate").alias("createdOn"))


SNAP_TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def snapshot_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior review snapshots: one per order, for the execution of twice its key (flat seed form). Executions of odd
    keys have none, and snapshots beyond the largest key belong to no known execution."""
    orders = read(spark, sf_dir, "orders").repartition("o_orderkey")  # a file may be one row group, and so one task
    k = F.col("o_orderkey")
    status = (F.when(k % 5 == 0, F.lit("PENDING")).when(k % 5 == 1, F.lit("pending"))
              .when(k % 5 == 2, F.lit("REJECTED")).when(k % 5 == 3, F.lit("ON HOLD"))
              .otherwise(F.lit("ACCEPTED")))
    ts = F.expr("timestamp'2001-08-10 00:00:00' - make_dt_interval(o_orderkey % 10, o_orderkey % 24, 0, 0)")
    updated = (F.when(k % 17 == 0, F.lit("not-a-date")).when(k % 19 == 0, F.lit(None).cast("string"))
               .otherwise(F.date_format(ts, SNAP_TS_FMT)))
    return (orders.select((k * 2).alias("exec_id"), F.concat(F.lit("S"), k.cast("string")).alias("snapshot_id"),
                          status.alias("status"), updated.alias("updated_on")))


def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions from the events table (every event is one decision).

    purchase -> approve the rank-1 suggestion of an invalid field
    view     -> approve a custom (dropdown) value on an invalid field
    click    -> approve the rank-1 suggestion of a metadata name
    error    -> reject;  signup -> draft a new CPUModel record
    """
    events = read(spark, sf_dir, "events")
    orders = read(spark, sf_dir, "orders")
    part = read(spark, sf_dir, "part")
    n_orders = orders.select(F.count(F.lit(1))).scalar()
    n_part = part.select(F.count(F.lit(1))).scalar()
    e = events
    kind = (F.when(F.col("event_type").isin("purchase", "view", "click"), F.lit("approve"))
            .when(F.col("event_type") == "error", F.lit("reject")).otherwise(F.lit("draft")))
    base = e.select(F.col("event_id").alias("decision_id"), "ts", kind.alias("kind"),
                    (F.col("event_id") % n_orders).alias("_ek"), F.col("event_type").alias("_et"))
    drafts = (base.where(F.col("kind") == "draft")
              .join(part, F.col("p_partkey") == F.col("_ek") % n_part)
              .select("decision_id",
                      F.when(F.col("decision_id") % 3 == 0, F.concat(F.col("p_name"), F.lit(" v2")))
                      .otherwise(F.concat(F.col("p_name"), F.lit(" gen"), (F.col("decision_id") % 3).cast("string")))
                      .alias("value"),
                      F.create_map(F.lit("Family"), F.col("p_type")).alias("metadata")))
    return (base.join(drafts, "decision_id", "left")
            .select("decision_id", "ts", "kind", F.col("_ek").cast("string").alias("execution_id"),
                    F.col("_et").alias("event_type"),
                    F.when(F.col("kind") == "draft", F.lit("cpumodel")).alias("type"), "value", "metadata"))
