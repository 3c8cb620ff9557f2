"""Pages of a sorted table by an index of key ranges.

``key_index`` range-partitions the table by its key once and writes each range as a folder of its own, with the number of rows and
the offset of every range beside it.  A page is then a scan of the one or two folders that hold its rows: page 10,000 costs
what page 1 costs, where ``orderBy().offset()`` sorts the table and skips all rows before the page each time.

Cases: key columns that leave ties give pages that follow the order but may deal tied rows in any order, so the key should name a row;
null keys come last; a page beyond the end, or of an empty table, is empty.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hygeia.session import checkpoint_dir, materialize

ROWS_PER_RANGE = 100_000


@dataclass
class KeyIndex:
    """rows: the table, in folders ``_range``; ranges: (_range, n, start), one row per folder."""

    rows: DataFrame
    ranges: DataFrame
    keys: list[str]
    total: int

    def touched(self, page_no: int, size: int) -> list:
        """The ranges that hold rows of a page, with the offset of their first row: at most as many as a page has rows."""
        low = (page_no - 1) * size
        hit = self.ranges.where((F.col("start") < low + size) & (F.col("start") + F.col("n") > low))
        return hit.orderBy("start").limit(size).collect()

    def page(self, page_no: int = 1, size: int = 50) -> DataFrame:
        if not 1 <= size <= 500 or page_no < 1:
            raise ValueError("a page has 1 to 500 rows and pages count from 1")
        hit = self.touched(page_no, size)
        if not hit:
            return self.rows.drop("_range").limit(0)
        own = self.rows.where(F.col("_range").isin([r["_range"] for r in hit])).drop("_range")
        skip = (page_no - 1) * size - hit[0]["start"]
        return own.orderBy(*[F.desc_nulls_last(k) for k in self.keys]).offset(skip).limit(size)


def key_index(df: DataFrame, keys: list[str], rows_per_range: int = ROWS_PER_RANGE) -> KeyIndex:
    """The index of ``df`` in descending order of ``keys``."""
    spark = df.sparkSession
    df = materialize(df, "page_rows")
    total = df.count()
    order = [F.desc_nulls_last(k) for k in keys]
    cut = df.repartitionByRange(max(1, math.ceil(total / rows_per_range)), *order).withColumn("_range", F.spark_partition_id())
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/pages-{uuid.uuid4().hex}"
    cut.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_range").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = materialize(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "page_ranges")
    return KeyIndex(rows, ranges, keys, total)
