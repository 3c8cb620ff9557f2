"""TF-IDF character n-gram nearest-neighbour join with bounds.

Scoring (scikit-learn ``TfidfVectorizer(analyzer='char', ngram_range=(2, 4))``
defaults): lower-case, runs of 2+ whitespace -> one space, grams of length n
only when n <= length, raw term counts, smooth idf = ln((1+N)/(1+df)) + 1,
L2-normalised rows; query grams outside the index vocabulary are ignored;
score = cosine.  One index per group key (e.g. field type).

Plan: the inverted index (weights, number and greatest weight of each gram's
postings) is written once and read by all steps.  A query's grams are put in
order of rarity.  What the grams from a place on can add to any document's
score is at most the norm of their weights, and at most the sum of their
weights times the greatest weight of each gram's postings.

1. The rarest grams, about ``SEED`` postings a query, propose ``n`` documents; the
   exact scores of these give a threshold that the n-th best can't be below.
2. Documents that share only grams from the place on where that bound falls
   below the threshold can't reach it, so only the grams before it (few and
   rare) look up postings.  A posting knows the norm of its document from this gram on,
   too: it opens a pair only if the product of both norms reaches the threshold, so weight
   that a document spends on rare grams of its own counts against it.
3. The pairs opened look up their other grams in a few steps; after each, those go on whose
   score so far and the most that the grams left can add reach the threshold.

So the frequent grams, whose postings are most of the index, are never joined
with all queries; no pair that can be among the first n is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hygeia.session import materialize

#: Postings that a query's rarest grams may open for the first proposals.
SEED = 64
#: Parts of the threshold at which a query's grams are cut into steps.
PARTS = (1.0, 0.6)
#: Scores are ranked at 1e-10, so bounds leave a little more.
EPS = 1e-9


def char_grams(text: Column, nmin: int = 2, nmax: int = 4) -> Column:
    t = F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")
    parts = []
    for n in range(nmin, nmax + 1):
        parts.append(F.when(F.length(t) >= n, F.transform(
            F.sequence(F.lit(0), F.length(t) - n), lambda i: F.substring(t, i + 1, n)))
            .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def _tf(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return (df.select(*keys, F.explode(char_grams(F.col(text))).alias("gram"))
            .groupBy(*keys, "gram").agg(F.count(F.lit(1)).cast("double").alias("tf")))


def build_index(docs: DataFrame, group: str, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (group, doc_id, gram, w, after, from), L2-normalised, and grams (group, gram, idf, df, top = greatest w); both written
    once. ``after`` (``from``) is the norm of the document's grams after this one (and this one),
    in the order in which queries look grams up."""
    tf = _tf(docs.select(group, doc_id, text), [group, doc_id], text)
    n_docs = docs.groupBy(group).agg(F.count(F.lit(1)).alias("_N"))
    dfreq = tf.groupBy(group, "gram").agg(F.count(F.lit(1)).alias("df"))
    idf = (dfreq.join(n_docs, group)
           .select(group, "gram", "df", (F.log((1 + F.col("_N")) / (1 + F.col("df"))) + 1).alias("idf")))
    w = tf.join(idf, [group, "gram"]).select(group, doc_id, "gram", "idf", "df", (F.col("tf") * F.col("idf")).alias("w"))
    doc = Window.partitionBy(group, doc_id)
    later = doc.orderBy("df", "gram").rowsBetween(1, Window.unboundedFollowing)
    square, norm = F.col("w") * F.col("w"), F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))
    index = materialize(w.select(group, doc_id, "gram", "idf", "df", (F.col("w") / norm).alias("w"),
                                 (F.sqrt(F.coalesce(F.sum(square).over(later), F.lit(0.0))) / norm).alias("after")), "gram_postings")
    grams = materialize(index.groupBy(group, "gram").agg(F.first("idf").alias("idf"), F.first("df").alias("df"), F.max("w").alias("top")),
                        "gram_weights")
    start = F.sqrt(F.col("w") * F.col("w") + F.col("after") * F.col("after")).alias("from")
    return index.select(group, doc_id, "gram", "w", "after", start), grams


@dataclass
class Steps:
    """The rows that each step of a join looked up, and the final scores (group, _q, doc_id, _s)."""

    read: list[DataFrame]
    scores: DataFrame


def _query_grams(queries: DataFrame, grams: DataFrame, group: str) -> DataFrame:
    """(group, _q, gram, w, df, seen, norm, most): weights, postings of the rarer grams, and the two bounds from this gram on."""
    qtf = _tf(queries, [group, "_q"], "_q")
    qw = qtf.join(grams, [group, "gram"]).select(group, "_q", "gram", "df", "top", (F.col("tf") * F.col("idf")).alias("w"))
    whole = Window.partitionBy(group, "_q")
    rarest = whole.orderBy("df", "gram")
    on = rarest.rowsBetween(0, Window.unboundedFollowing)
    before = rarest.rowsBetween(Window.unboundedPreceding, -1)
    qw = qw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))
    return qw.select(group, "_q", "gram", "w", F.coalesce(F.sum("df").over(before), F.lit(0)).alias("seen"),
                     F.sqrt(F.sum(F.col("w") * F.col("w")).over(on)).alias("norm"), F.sum(F.col("w") * F.col("top")).over(on).alias("most"))


def knn_steps(queries: DataFrame, index: DataFrame, grams: DataFrame, group: str, doc_id: str, n: int,
              min_score: float | None = None) -> Steps:
    """queries: distinct (group, _q); index, grams: ``build_index``."""
    pair, query = [group, "_q", doc_id], [group, "_q"]
    postings = index.withColumnRenamed("w", "_wd")
    product = F.sum(F.col("w") * F.col("_wd"))
    qg = materialize(_query_grams(queries, grams, group), "query_grams")

    proposals = qg.where(F.col("seen") < SEED).select(*query, "gram", "w").join(postings, [group, "gram"])
    first = Window.partitionBy(*query).orderBy(F.desc("_s"), doc_id)
    seeds = (proposals.groupBy(*pair).agg(product.alias("_s")).withColumn("_r", F.row_number().over(first))
             .where(F.col("_r") <= n).select(*pair))
    exact = (seeds.join(qg.select(*query, "gram", "w"), query).join(postings, [group, doc_id, "gram"])
             .groupBy(*pair).agg(product.alias("_s")))
    floor = 0.0 if min_score is None else min_score - 0.00005
    known = (exact.groupBy(*query).agg(F.min("_s").alias("_low"), F.count(F.lit(1)).alias("_k"))
             .select(*query, F.greatest(F.when(F.col("_k") >= n, F.col("_low")).otherwise(F.lit(0.0)), F.lit(floor)).alias("theta")))

    # step 0: grams that alone can reach the threshold; later steps: grams that can reach a part of it
    bound, step = F.least("norm", "most"), F.lit(len(PARTS))
    for k, part in reversed(list(enumerate(PARTS))):
        step = F.when(bound >= part * F.col("theta") - EPS, k).otherwise(step)
    marked = materialize(qg.join(known, query).withColumn("step", step), "bounded_grams")
    # a pair whose first common gram is here is at most the product of both norms from it on: such postings open a pair
    opens = (F.col("step") == 0) & (F.col("norm") * F.col("from") >= F.col("theta") - EPS)
    own = marked.select(*query, "gram", "w", "norm", "theta", "step")
    met = own.where("step = 0").join(postings, [group, "gram"]).where(opens)
    later = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") * F.col("norm") - F.col("w") * F.col("w"))) * F.col("after")
    part = met.groupBy(*pair).agg(product.alias("_s"), F.min("after").alias("_after"), F.first("theta").alias("theta"), F.min(later).alias("_can"))
    able = materialize(part.where(F.col("_s") + F.col("_can") >= F.col("theta") - EPS).drop("_can"), "able")
    read = [met]
    for k in range(1, len(PARTS) + 1):  # the rest of the pair, cut down after each step
        rest = marked.where(F.col("step") > k).groupBy(*query).agg(F.max("norm").alias("rest_norm"), F.max("most").alias("rest_most"))
        now = own.where(F.col("step") <= 1) if k == 1 else own.where(F.col("step") == k)
        met = able.select(*pair).join(now, query).join(postings, [group, doc_id, "gram"]).where(~opens)
        read.append(met)
        part = met.groupBy(*pair).agg(product.alias("_more"), F.min("after").alias("_last"))
        can = F.coalesce(F.least(F.col("rest_most"), F.col("rest_norm") * F.col("_after")), F.lit(0.0))
        able = materialize(able.join(part, pair, "left").withColumn("_s", F.col("_s") + F.coalesce("_more", F.lit(0.0)))
                           .withColumn("_after", F.least("_after", "_last")).join(rest, query, "left")
                           .where(F.col("_s") + can >= F.col("theta") - EPS).select(*pair, "_s", "_after", "theta"), "able")
    return Steps([proposals, *read], able.select(*pair, "_s"))


def knn_join(queries: DataFrame, docs: DataFrame, group: str, q_text: str, doc_id: str, d_text: str,
             order: str, n: int = 3, min_score: float | None = None) -> DataFrame:
    """Top-n index documents per distinct (group, query text).

    queries: rows with (group, q_text); docs: (group, doc_id, d_text, order).
    Returns (group, q_text, rank, doc_id, score) with score = bround(cosine, 4),
    ranked by score desc then ``order``.  Queries with no known gram return
    no rows (deviation D4).
    """
    index, grams = build_index(docs, group, doc_id, d_text)
    qd = queries.select(group, F.col(q_text).alias("_q")).distinct()
    found = knn_steps(qd, index, grams, group, doc_id, n, min_score).scores
    scored = found.join(docs.select(group, doc_id, order), [group, doc_id]).withColumn("score", F.bround("_s", 4))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    # rank on the score at 1e-10 (equal texts tie exactly, then by ``order``)
    w = Window.partitionBy(group, "_q").orderBy(F.desc(F.bround("_s", 10)), F.asc(order))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(group, F.col("_q").alias(q_text), "rank", doc_id, "score"))
