"""Document fingerprints: the bottom-k sketch of a text's shingle hashes (DataFrame functions only).

A sketch is the sorted array of the ``k`` smallest 64-bit hashes of the
text's distinct word shingles (a text of fewer words is one shingle).  Sketches of parts
merge into the sketch of the whole, and estimate how many distinct shingles there are,
resemblance (Jaccard) and containment.

Cases: a null or empty text has no shingles and an empty sketch; two empty sketches are alike (1), an empty one
and another aren't (0); repeated rows have equal sketches; ``next_documents`` orders rows by doc_id, then text (null doc_ids
last in descending order); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hygeia.llm.common import WORD, block_count, range_block, range_bounds

K, WIDTH = 128, 5


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_hashes(text: str | Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def bottom_k(hashes: str | Column, k: int = K, width: int = WIDTH) -> Column:
    """Sketch of a document's word hashes (a column of its own: it is read once per shingle)."""
    h = _c(hashes)
    n = F.size(h)
    each = F.transform(F.sequence(F.lit(0), n - width),
                       lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
    shingles = F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: str | Column, b: str | Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(_c(a), _c(b))), 1, k)


def merge_parts(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of each group from the sketches of its parts, in two steps so that no task holds a large group:
    the k smallest of each hash range first, then of the few that are left."""
    h = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    order = W.partitionBy(*keys, "_part").orderBy("_h")
    few = (h.withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
           .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k))
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch))


def distinct_shingles(sketch: str | Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a fraction."""
    s = _c(sketch)
    u = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / u)


def resemblance(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both sketches hold."""
    a, b = _c(a), _c(b)
    u = merge(a, b, k)
    common = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common / F.size(u))


def containment(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def fingerprint(sketch: str | Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(_c(sketch), lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def next_documents(docs: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text, _block and next_text, the text of the next document in descending doc_id (after the last: the first).

    Neighbours meet inside blocks of doc_id ranges; only the first document of each block crosses to another."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bounds = range_bounds(docs, "doc_id", block_count(spark, size, chunk_bytes, 256 << 10))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_block", range_block("doc_id", bounds))
    heads = d.groupBy("_block").agg(F.max(F.struct("doc_id", "text")).alias("h")).select("_block", F.col("h.text").alias("text"))
    lower = heads.select("_block").withColumn("_from", F.coalesce(
        F.lead("_block").over(W.partitionBy(F.lit(0)).orderBy(F.desc("_block"))),
        F.max("_block").over(W.partitionBy(F.lit(0)))))
    follow = (lower.join(heads.select(F.col("_block").alias("_from"), F.col("text").alias("_head")), "_from")
              .select(F.col("_block").alias("_b"), "_head"))
    w = W.partitionBy("_block").orderBy(F.col("doc_id").desc_nulls_last(), F.desc("text"))
    d = d.withColumn("_lead", F.lead("text").over(w))
    return (d.join(follow, d["_block"] == F.col("_b"))
            .select("doc_id", "text", "_block", F.coalesce("_lead", "_head").alias("next_text"),
                    F.col("_lead").isNull().alias("_last")))


def edited_fingerprints(docs: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Every document's sketch beside that of its edited text (its second half replaced by the start of the next
    document) and of the next document."""
    d = next_documents(docs, chunk_bytes)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substr(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                      F.expr("substr(next_text, 1, cast(floor(char_length(text) / 2) as int))"))
    d = d.select("doc_id", "text", "_block", "_last", F.char_length("text").cast("bigint").alias("n_chars"),
                 F.when(F.col("_last"), F.col("next_text")).alias("_head"),
                 F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"))
    d = d.select("doc_id", "text", "_block", "_last", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                 word_hashes("text").alias("_own"), word_hashes("edited").alias("_edited"),
                 F.when(F.col("_last"), word_hashes("_head")).alias("_next"))
    d = d.select("doc_id", "text", "_block", "_last", "n_chars", "edited_sha256", bottom_k("_own").alias("sketch"),
                 bottom_k("_edited").alias("edited_sketch"), F.when(F.col("_last"), bottom_k("_next")).alias("_next_sketch"))
    w = W.partitionBy("_block").orderBy(F.col("doc_id").desc_nulls_last(), F.desc("text"))
    lead = F.lead("sketch").over(w)
    return d.withColumn("next_sketch", F.coalesce("_next_sketch", lead)).select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")
