"""Shards along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Each dimension is cut into 2^bits steps (ordered values by rank, numbers by
quantile or logarithm) and the steps of a row give its index on the curve.
Rows in curve order are cut into runs of equal counts; near rows of the curve are near in every dimension, so
a run (one shard, one file) spans a small part of each and its minima and maxima prune it.

A row's rank is counted in three levels: over the curve's coarse cells
(at most 4,096 rows), over the cells and hash parts inside one, and over the
rows inside a part, so a cell that holds a third of all rows is many tasks.

Cases: a null or empty text has size 1; a null source or language is a value of its own, last; a null doc_id is in the
lowest step; equal index: by hash of doc_id, then doc_id, then content; repeated rows get a slot
each; an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hygeia.llm.common import range_block, range_bounds, running_sum

#: Rows in the smallest part of a cell.
PART_ROWS = 50_000
COARSE_BITS = 12


def curve_tables(n: int) -> dict[str, list[int]]:
    """For n dimensions, the steps of the Hilbert curve (Hamilton and Rau-Chaplin, 2008): Gray code rank,
    entry corner and direction of each sub-cube, and rotations of n bits by 0..n-1 places."""
    full = 2**n
    gray = [i ^ (i >> 1) for i in range(full)]
    ones = lambda i: len(bin(i)) - len(bin(i).rstrip("1"))  # noqa: E731  trailing set bits
    return {
        "rank": [gray.index(g) for g in range(full)],
        "entry": [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, full)],
        "turn": [0] + [(ones(i) if i % 2 else ones(i - 1)) % n for i in range(1, full)],
        "left": [((x << r) | (x >> (n - r))) & (full - 1) for r in range(n) for x in range(full)],
    }


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the curve of a point whose coordinates are integers below 2^bits."""
    n, full = len(dims), 2**len(dims)
    t = {k: F.lit(v) for k, v in curve_tables(n).items()}

    def rotate(x: Column, places: Column) -> Column:
        return F.get(t["left"], places * full + x)

    levels = [reduce(lambda a, b: a.bitwiseOR(b), [
        F.shiftleft(F.shiftright(d.cast("int"), i).bitwiseAND(1), k) for k, d in enumerate(dims)]) for i in reversed(range(bits))]

    def step(s: Column, corner: Column) -> Column:
        right = (F.lit(n) - (s["turn"] + 1) % n) % n
        w = F.get(t["rank"], rotate(corner.bitwiseXOR(s["entry"]), right))
        return F.struct((s["index"] * full + w).alias("index"),
                        s["entry"].bitwiseXOR(rotate(F.get(t["entry"], w), (s["turn"] + 1) % n)).alias("entry"),
                        ((s["turn"] + F.get(t["turn"], w) + 1) % n).cast("int").alias("turn"))

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    return F.aggregate(F.array(*levels), start, step, lambda s: s["index"])


def _ranked(df: DataFrame, column: str, steps: int) -> DataFrame:
    """(value, step): the distinct values in order, nulls last, dealt evenly over the steps."""
    values = df.groupBy(F.col(column).alias(f"_v_{column}")).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy(F.col(f"_v_{column}").asc_nulls_last())) - 1
    n = F.count(F.lit(1)).over(whole)
    return values.select(f"_v_{column}", F.floor(rank * steps / F.greatest(n, F.lit(steps))).cast("int").alias(f"_s_{column}"))


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 4) -> DataFrame:
    """``docs`` (doc_id, source, lang, text and more) with size, text_crc32, curve, shard and slot; counts
    of shards are at most one apart (clashing columns are replaced)."""
    new = ["size", "text_crc32", "curve", "shard", "slot"]
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    named = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = docs.count()
    steps = 2**bits
    bounds = range_bounds(docs, "doc_id", steps)
    d = docs.select(*named, (F.octet_length(raw) + 1).cast("bigint").alias("size"),
                    F.crc32(raw).cast("bigint").alias("text_crc32"))
    for c in ("source", "lang"):
        d = d.join(_ranked(docs, c, steps), F.col(c).eqNullSafe(F.col(f"_v_{c}")), "left").drop(f"_v_{c}")
    log = F.least(F.floor(F.log2("size")), F.lit(steps - 1)).cast("int")
    dims = [F.col("_s_source"), F.col("_s_lang"), log, range_block("doc_id", bounds)]
    d = d.withColumn("curve", hilbert_index(dims, bits))
    parts = max(1, math.ceil(rows / PART_ROWS))
    fine = max(0, bits * len(dims) - COARSE_BITS)
    key = F.xxhash64(F.col("doc_id"), F.lit(23))
    d = (d.withColumn("_key", key).withColumn("_coarse", F.shiftright("curve", fine).cast("int"))
         .withColumn("_part", F.col("curve") * parts + F.expr(f"shiftrightunsigned(_key, 33) * {parts} div {2**31}")))
    inner = running_sum(d, ["_coarse"], "_part", [F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"),
                                                  F.col("size")], F.lit(1), "_inner")
    cells = d.groupBy(F.col("_coarse").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    r = inner.join(cells, F.col("_coarse") == F.col("_cell")).withColumn("_rank", F.col("_before") + F.col("_inner"))
    shard = F.expr(f"_rank * {shards} div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (r.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("bigint"))
            .select(*named, *new))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
