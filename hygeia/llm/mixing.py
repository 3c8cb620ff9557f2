"""Mixing sources to target weights: hash-random order inside each source, running sums, an exact cut.

Each source's documents are put in the order of a hash of doc_id.  Hash
ranges cut a source into blocks; sums per block, running sums over
blocks and a window inside a block give every document its place on the
source's axis of words, however large the source.  A target of more than the source's
size takes whole epochs first; the last, partial epoch is cut at the exact budget, inside one document.
``mixed_documents`` hands out whole documents: the one at the cut stays if at least half of it is taken.

Cases: null texts and empty texts have size 0 and are never taken; a null
source is a source of its own, ranked last; equal hashes are settled by doc_id, repeated rows each count; a null doc_id
is hashed like any value; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hygeia.llm.common import WORD, block_count, running_sum

#: Rows in a block of a source.
BLOCK_ROWS = 50_000


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("bigint")


def text_digest(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Target = min(level x weight, most x size), with the level at which the targets add up to all sizes: in
    the order of most x size / weight, the first level that doesn't pass its own source's limit."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * most).cast("double")
    by = W.orderBy("_full", "_rank")
    w = (sizes.withColumn("_rank", rank).withColumn("_w", weight)
         .withColumn("_cap", cap).withColumn("_full", F.col("_cap") / F.col("_w")))
    capped = F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing))
    whole = W.partitionBy(F.lit(0))
    w = w.withColumn("_level", (F.sum("source_size").over(whole) - capped) / free)
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(whole)["_level"]
    return (w.withColumn("_level", F.coalesce(level, F.lit(float("inf"))))
            .select("source", "source_size", F.least(F.col("_level") * F.col("_w"), F.col("_cap")).alias("target")))


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1),
                most: int = 3, seed: int = 11, tie: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken (clashing columns are replaced). Rows that share a doc_id, or have none,
    are in the order of their size and of ``tie`` (a digest of the text, if there is one): reruns cut at the same row."""
    new = ["size", "source_size", "target", "taken"]
    size = word_count() if size is None else size
    named = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    # 60 bits of a digest of the id: the same in any engine
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")),
                             1, 15), 16, 10).cast("bigint")
    narrow = docs.select("source", size.alias("size"))
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = block_count(docs.sparkSession, docs.count(), BLOCK_ROWS, 1_000)
    if tie is None:
        tie = text_digest() if "text" in docs.columns else F.lit(None).cast("string")
    placed = docs.select(*named, size.alias("size"), key.alias("_key"), tie.alias("_tie")).withColumn(
        "_block", F.expr(f"cast(shiftright(_key, 29) * {blocks} div {2**31} as int)"))
    runs = running_sum(placed, ["source"], "_block", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_tie")], F.col("size"), "_before")
    targets = source_targets(per, weights, most).withColumnRenamed("source", "_source")
    j = runs.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size") + 0.5)
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return j.select(*named, "size", "source_size", "target", (F.col("size") * epochs + part).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each document as often as it is taken (columns of ``docs``)."""
    mixed = mix_sources(docs, **params).where("2 * taken >= size and size > 0")
    copies = F.sequence(F.lit(1), F.expr("cast((2 * taken + size) div (2 * size) as int)"))
    return mixed.withColumn("_copy", F.explode(copies)).select(*[F.col(f"`{c}`") for c in docs.columns])
