"""Connected components of an edge table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hygeia.llm.common import Scratch


def components(edges: DataFrame, work: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Alternates two contractions until nothing changes: every larger neighbour of a node is linked to the
    node's smallest neighbour, then every smaller one.  Minima are partial aggregates, so a node
    with very many edges is no single task; the edge table never grows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    cur = work.table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    mark, step = None, 0
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        # counted while it's written: no further job over the table
        seen = Observation()
        sign = F.xxhash64("u", "v").cast("decimal(38,0)")
        nxt = work.table(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(sign).alias("s")), f"edges{step}")
        now = (seen.get["n"], seen.get["s"])
        work.drop(f"edges{step - 1}")
        cur = nxt
        if now == mark:
            break
        mark = now
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
