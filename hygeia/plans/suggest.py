"""Standardisation suggestions for invalid fields.

Record level (J9): the observed record signature (value + metadata values) is
matched against masterlist record signatures of the same type with the
TF-IDF kNN join; each suggestion then gets per-field ``ratio`` scores (X3).
Field level (J10): observed single values against the valid values (or, for
metadata names, the metadata values) of that field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.functions import fuzzy as FZ
from hygeia.functions import text as T
from hygeia.operators.knn import knn_join
from hygeia.plans.rules import RuleSet
from hygeia.session import materialize, sized_broadcast


def payload_entries(validated: DataFrame, id_col: str = "exec_id") -> DataFrame:
    """One row per invalid payload entry with its observed signature."""
    e = validated.select(id_col, F.posexplode("invalidPayload").alias("field_pos", "e"))
    metas = F.array_sort(F.col("e.metadata"))  # struct order: by name first
    parts = F.concat(F.array(T.py_strip(F.col("e.value"))),
                     F.transform(F.filter(metas, lambda m: T.py_strip(m["value"]) != ""),
                                 lambda m: T.py_strip(m["value"])))
    return e.select(id_col, "field_pos", F.col("e.field").alias("field"), F.col("e.value").alias("value"),
                    F.col("e.metadata").alias("metadata"), T.signature(parts).alias("qsig"))


def record_suggestions(rules: RuleSet, validated: DataFrame, n: int = 3, id_col: str = "exec_id",
                       min_score: float | None = None) -> DataFrame:
    """J9 per payload entry: (exec_id, field_pos, field, value, metadata, rank, ml_id,
    primary_value, sug_metadata, overall_score)."""
    entries = payload_entries(validated, id_col)
    sigs = rules.signatures
    nn = knn_join(entries.select("field", "qsig"), sigs, group="field", q_text="qsig",
                  doc_id="ordinal", d_text="signature", order="ordinal", n=n, min_score=min_score)
    nn = nn.join(sigs.select("field", "ordinal", "ml_id", "primary_value",
                             F.col("metadata").alias("sug_metadata")), ["field", "ordinal"])
    # written, measured and broadcast when small: entries of a frequent signature then stay where they are
    nn = sized_broadcast(materialize(nn, "neighbours"))
    return (entries.join(nn, ["field", "qsig"])
            .select(id_col, "field_pos", "field", "value", "metadata", "rank", "ml_id", "primary_value",
                    "sug_metadata", F.col("score").alias("overall_score")))


def suggestion_items(rec: DataFrame, id_col: str = "exec_id") -> DataFrame:
    """X3 long form: one row per (entry, item, rank) with field score ``ratio`` (0 if either side empty)."""
    prim = rec.select(id_col, "field_pos", "field", F.lit("primary").alias("item"), F.lit(-1).alias("item_pos"),
                      F.col("field").alias("name"), "rank", F.col("primary_value").alias("suggestion"),
                      F.lower("value").alias("_a"), F.lower("primary_value").alias("_b"), "overall_score", "ml_id")
    meta = (rec.select(id_col, "field_pos", "field", "rank", "ml_id", "overall_score", "sug_metadata",
                       F.posexplode("metadata").alias("item_pos", "m"))
            .select(id_col, "field_pos", "field", F.lit("metadata").alias("item"), "item_pos",
                    F.col("m.name").alias("name"), "rank",
                    F.coalesce(F.col("sug_metadata")[F.col("m.name")], F.lit("")).alias("suggestion"),
                    F.lower(F.coalesce(F.col("m.value"), F.lit(""))).alias("_a"),
                    F.lower(F.coalesce(F.col("sug_metadata")[F.col("m.name")], F.lit(""))).alias("_b"),
                    "overall_score", "ml_id"))
    both = prim.unionByName(meta)
    scored = FZ.with_ratio(both, "_a", "_b", "score")
    return scored.select(id_col, "field_pos", "field", "item", "item_pos", "name", "rank", "suggestion",
                         "score", "overall_score", F.lit("PENDING").alias("status"), "ml_id")


def field_suggestions(rules: RuleSet, queries: DataFrame, n: int = 3) -> DataFrame:
    """(field, value) -> top-n of the field's valid values (metadata values for metadata names)."""
    prim_fields = [m.field for m in rules.mappings if m.primary]
    vv = rules.values.select("field", F.col("value").alias("cand"), "ml_id", "ordinal")
    mv = (rules.meta_values.where(~F.col("name").isin(*prim_fields) if prim_fields else F.lit(True))
          .select(F.col("name").alias("field"), F.col("value").alias("cand"), "ml_id",
                  F.lit(None).cast("bigint").alias("ordinal")))
    # possibilities: valid values, else (metadata names) the metadata values
    with_vv = vv.select("field").distinct()
    cands = vv.unionByName(mv.join(with_vv, "field", "left_anti"))
    cands = cands.withColumn("cand_id", F.xxhash64("field", "cand"))
    nn = knn_join(queries.select("field", "value"), cands, group="field", q_text="value",
                  doc_id="cand_id", d_text="cand", order="cand", n=n)
    return (nn.join(cands.select("field", "cand_id", "cand", "ml_id"), ["field", "cand_id"])
            .select("field", "value", "rank", F.col("cand").alias("suggestion"), "ml_id", "score"))


def field_suggestions_fuzzy(rules: RuleSet, queries: DataFrame, n: int = 3, cutoff: float = 10) -> DataFrame:
    """partial_ratio over default-processed strings, cut-off 10, top-n of the field's valid values
    (metadata values for metadata names)."""
    from hygeia.operators.fuzzy_join import fuzzy_join
    prim_fields = [m.field for m in rules.mappings if m.primary]
    vv = rules.values.select("field", F.col("value").alias("cand"), "ml_id")
    mv = (rules.meta_values.where(~F.col("name").isin(*prim_fields) if prim_fields else F.lit(True))
          .select(F.col("name").alias("field"), F.col("value").alias("cand"), "ml_id"))
    cands = vv.unionByName(mv.join(vv.select("field").distinct(), "field", "left_anti"))
    top = fuzzy_join(queries.select("field", "value"), cands, "field", "value", "cand", "cand",
                     "partial_ratio", cutoff, n, process=True)
    return (top.join(cands, ["field", "cand"])
            .select("field", "value", "rank", F.col("cand").alias("suggestion"), "ml_id", "score"))


def record_suggestions_fuzzy(rules: RuleSet, validated: DataFrame, n: int = 3, cutoff: float = 75,
                             id_col: str = "exec_id") -> DataFrame:
    """token_set_ratio between observed and masterlist signatures, cut-off 75, top-n."""
    from hygeia.operators.fuzzy_join import fuzzy_join
    entries = payload_entries(validated, id_col).where(F.col("qsig") != "")
    sigs = rules.signatures
    top = fuzzy_join(entries.select("field", "qsig"), sigs, "field", "qsig", "signature", "ordinal",
                     "token_set_ratio", cutoff, n)
    top = top.join(sigs.select("field", "ordinal", "ml_id", "primary_value"), ["field", "ordinal"])
    return (entries.join(top, ["field", "qsig"])
            .select(id_col, "field", "rank", "ml_id", "primary_value", F.col("score").alias("overall_score")))


def fuzzy_exists(rules: RuleSet, validated: DataFrame, cutoff: float = 75, id_col: str = "exec_id",
                 matches: DataFrame | None = None) -> DataFrame:
    """Whether any masterlist signature of the field scores >= cut-off (empty signature -> false).

    ``matches`` may pass already computed J12 rows (exec, field, score) with the same or a lower
    cut-off, so the candidate scoring runs once for both operators.
    """
    entries = payload_entries(validated, id_col)
    if matches is None:
        matches = record_suggestions_fuzzy(rules, validated, 1, cutoff, id_col)
    hit = (matches.where(F.col("overall_score") >= F.lit(cutoff / 100.0) - F.lit(1e-9))
           .select(id_col, "field", F.lit(True).alias("_hit")).distinct())
    return (entries.join(hit, [id_col, "field"], "left")
            .select(id_col, "field", F.coalesce("_hit", F.lit(False)).alias("has_match")))


def resolve_terms(masterlist: DataFrame, terms: DataFrame, types: list[str], cutoff: float = 60,
                  source: str = "value") -> DataFrame:
    """Best WRatio match >= cut-off of each lower-cased term among the lower-cased distinct
    values of the given masterlist types, in its stored spelling (of several the greatest); unmatched terms come back as
    themselves, flagged not fuzzy.

    ``source='value'`` reads data.value (effective variant), ``source='metadata:<name>'`` reads a
    metadata value (shadowed variant).
    """
    t = terms.select("term", F.lit(0).alias("g"))
    return _best_choices(t, _choices(masterlist, types, source).withColumn("g", F.lit(0)), cutoff).drop("g")


def _choices(masterlist: DataFrame, types: list[str], source: str) -> DataFrame:
    """(choice, stored): the lower-cased values of the source, each with its stored spelling (of several the greatest)."""
    ml = masterlist.where(F.col("type").isin(*types))
    if source.startswith("metadata:"):
        v = F.col("data.metadata")[F.lit(source.split(":", 1)[1])]
    else:
        v = F.col("data.value")
    return (ml.select(F.lower(v).alias("choice"), v.alias("v")).where(F.col("choice").isNotNull() & (F.col("choice") != ""))
            .groupBy("choice").agg(F.max("v").alias("stored")))


def _best_choices(terms: DataFrame, choices: DataFrame, cutoff: float) -> DataFrame:
    """The best of ``choices`` (g, choice, stored) for each of ``terms`` (g, term), or the term itself."""
    from hygeia.operators.fuzzy_join import fuzzy_join
    t = terms.select("g", "term", F.lower("term").alias("lterm"))
    best = fuzzy_join(t, choices, "g", "lterm", "choice", "choice", "wratio", cutoff, 1)
    best = best.join(choices.select("g", "choice", "stored"), ["g", "choice"])
    return (t.join(best, ["g", "lterm"], "left")
            .select("g", "term", F.coalesce("stored", F.col("term")).alias("resolved"),
                    F.col("choice").isNotNull().alias("is_fuzzy"), "score"))


def resolve_term(masterlist: DataFrame, term: str, sources: dict[str, tuple[list[str], str]], cutoff: float = 60) -> DataFrame:
    """J14 for one term and several sources at once: (name, resolved, is_fuzzy), a row for each of ``sources``
    (name -> types, source)."""
    spark = masterlist.sparkSession
    names = [*sources]
    choices = None
    for g, n in enumerate(names):
        part = _choices(masterlist, *sources[n]).withColumn("g", F.lit(g))
        choices = part if choices is None else choices.unionByName(part)
    asked = spark.createDataFrame([(g, term) for g in range(len(names))], "g int, term string")
    return (_best_choices(asked, choices, cutoff)
            .select(F.get(F.array(*[F.lit(n) for n in names]), F.col("g")).alias("name"), "resolved", "is_fuzzy"))
