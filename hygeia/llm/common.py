"""Scratch tables, range blocks and distributed ranks shared by the operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hygeia.session import checkpoint_dir, shuffle_cleanup

#: Words everywhere in this package: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables of one operator call, under the shared checkpoint folder.

    A table cuts the lineage: after the loss of an executor only the running
    job is recomputed.  ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, op: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm/{op}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(spark: SparkSession, size: float, target: float, least: float) -> int:
    """Blocks of about ``target`` (bytes or rows): as many as there are shuffle partitions where
    they stay above ``least``, more where the input needs it."""
    return max(1, math.ceil(size / target), min(shuffle_partitions(spark), math.ceil(size / least)))


def range_bounds(df: DataFrame, col: str, n: int) -> list[int]:
    """At most ``n - 1`` increasing values that cut ``col`` (an integer) into ranges of about equal rows.

    Only these quantiles reach the driver; one aggregate over one column.
    """
    if n <= 1:
        return []
    qs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(col).cast("bigint"), qs, max(10_000, 20 * n)).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_block(col: str | Column, bounds: list, kind: str = "bigint") -> Column:
    """Index of the range of ``col``: the number of bounds <= its value (null: 0), by binary search."""
    c = (F.col(col) if isinstance(col, str) else col).cast(kind)
    if not bounds:
        return F.lit(0)
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    arr = F.lit(bounds)

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(arr, mid) <= c)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, step, lambda s: s["lo"])
    return F.when(c.isNull(), 0).otherwise(found)


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column,
                out: str, total: str | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before this one, within ``keys``, in the order (block, *order).

    ``block`` cuts each key into bounded parts, so a key that holds a third of
    all rows is many tasks: sums per (key, block) first, their running sums (one
    row per block) next, then a window inside each block.
    """
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_block_sum"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = over.orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offs = sums.withColumn("_before", F.coalesce(F.sum("_block_sum").over(before), F.lit(0)))
    if total:
        offs = offs.withColumn(total, F.sum("_block_sum").over(over))
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = [F.col(f"_o.{k}").eqNullSafe(F.col(f"_d.{k}")) for k in [*keys, block]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    joined = (df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("_d")
              .join(offs.alias("_o"), cond, "left"))
    cols = [F.col(f"_d.{c}") for c in df.columns]
    cols.append((F.col("_o._before") + F.col("_d._inside")).alias(out))
    if total:
        cols.append(F.col(f"_o.{total}"))
    return joined.select(*cols)
