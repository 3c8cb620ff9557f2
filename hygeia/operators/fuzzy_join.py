"""Fuzzy top-n join with a scorer and a cut-off (J11-J15, T3, T4), on *distinct* texts per group.

Two texts can only reach the cut-off ``c`` if they have enough in common. What they must have in common is looked up in the order
of rarity among the candidates, and only as far into a text as the bound asks (prefix filter): texts that reach the
cut-off share an item of that prefix, so nothing is lost, and the frequent items are not joined. The pairs met are cut down
by counts in the row, then scored by column expressions.

token_set_ratio (words joined by blanks, sorted, la and lb characters)
  * one side's words lie mostly in the other: the common words weigh (characters + 1) at least c / (2 - c) of that side;
  * or the texts are similar: of their bigrams (words padded with blanks) at least (la + lb)(1.5 c - 1) - 1 are common, as
    an edit spoils at most two, and c (la + lb) / 2 of their characters. Texts so short that this asks for no
    bigram, or a cut-off of 2/3 and below, are looked up by characters.
partial_ratio (m characters in the shorter text): a window that reaches c has at least c m / (2 - c) of its characters in common.
wratio: a score above 0 needs a common character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hygeia.functions import scores as S
from hygeia.functions import text as T

EPS = 1e-9


def _numbered(items: Column) -> Column:
    """Items of an array with their number among equal ones, so that multisets meet as sets."""
    return S.let(items, lambda held: F.transform(held, lambda x, i: F.struct(
        x.alias("x"), F.size(F.filter(F.slice(held, F.lit(1), i + 1), lambda y: y == x)).alias("k"))))


def _bigrams(words: Column) -> Column:
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))))


def _texts(df: DataFrame, group: str, text: str, process: bool) -> DataFrame:
    """Distinct (group, text) with the form that is scored and its words."""
    form = T.default_process(F.col("text")) if process else F.col("text")
    return (df.select(group, F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
            .withColumn("form", form).withColumn("words", S.tokens(F.col("form"))))


def _with_items(texts: DataFrame, group: str, scorer: str, c: float) -> DataFrame:
    """``texts`` with size, chars and one row per item (kind, item, weight, need): ``need`` is the weight that must be common at or after
    the first common item of this kind."""
    if scorer == "token_set_ratio":
        texts = texts.withColumn("whole", F.array_join("words", " "))
    else:
        texts = texts.withColumn("whole", F.col("form"))
    texts = texts.withColumn("size", F.length("whole")).withColumn("chars", _numbered(S.letters(F.col("whole"))))
    size = F.col("size")
    item = lambda kind, x, k, weight, need: F.struct(F.lit(kind).alias("kind"), x.alias("x"), k.cast("int").alias("k"),
                                                     weight.cast("double").alias("weight"), need.cast("double").alias("need"))
    by_char = F.transform("chars", lambda x: item("c", x["x"], x["k"], F.lit(1.0), F.greatest(F.lit(1.0), F.ceil(c / (2 - c) * size - EPS))))
    if scorer == "token_set_ratio":
        shared = 2 / (2 - c) * size * (1.5 * c - 1) - 1
        short = shared <= EPS
        words = F.transform("words", lambda w: item("t", w, F.lit(1), F.length(w) + 1, c / (2 - c) * (size + 1) - EPS))
        grams = F.transform(_numbered(_bigrams(F.col("words"))), lambda x: item("b", x["x"], x["k"], F.lit(1.0), F.ceil(shared - EPS)))
        none = F.slice(grams, 1, 0)
        items = F.concat(words, F.when(short, none).otherwise(grams) if c > 2 / 3 else none, F.when(short | F.lit(c <= 2 / 3), by_char).otherwise(none))
        if c > 2 / 3:  # a short text may still meet one that isn't: by any bigram
            any_gram = F.transform(_numbered(_bigrams(F.col("words"))), lambda x: item("b", x["x"], x["k"], F.lit(1.0), F.lit(1.0)))
            items = F.concat(items, F.when(short, any_gram).otherwise(none))
    elif scorer == "partial_ratio":
        items = by_char
    else:
        items = F.transform(F.array_distinct(S.letters(F.col("whole"))), lambda x: item("c", x, F.lit(1), F.lit(1.0), F.lit(0.0)))
    return texts.withColumn("i", F.explode(items)).select(*texts.columns, "i.*")


def _prefix(items: DataFrame, rarity: DataFrame, group: str) -> DataFrame:
    """(group, text, size, kind, x, k, head): head where the items from this one on, rarest first, still weigh what's needed."""
    key = [group, "kind", "x", "k"]
    on = (Window.partitionBy(group, "text", "kind").orderBy(F.coalesce("df", F.lit(0)), "x", "k").rowsBetween(0, Window.unboundedFollowing))
    return (items.join(rarity, key, "left").withColumn("head", F.sum("weight").over(on) >= F.col("need") - EPS)
            .select(group, "text", "size", "kind", "x", "k", "head"))


def candidate_pairs(queries: DataFrame, cands: DataFrame, group: str, scorer: str, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """(pairs group, _q, _c met on items; pairs left after the counts in the row, with both sides' form and words).
    queries, cands: ``_texts``."""
    c = cutoff / 100.0
    qi, ci = _with_items(queries, group, scorer, c), _with_items(cands, group, scorer, c)
    rarity = ci.groupBy(group, "kind", "x", "k").agg(F.count(F.lit(1)).alias("df"))
    q, d = _prefix(qi, rarity, group).alias("q"), _prefix(ci, rarity, group).alias("d")
    same = [F.col(f"q.{x}") == F.col(f"d.{x}") for x in (group, "kind", "x", "k")]
    if scorer == "token_set_ratio":  # words: the prefix of either side; else of both
        meet = F.when(F.col("q.kind") == "t", F.col("q.head") | F.col("d.head")).otherwise(F.col("q.head") & F.col("d.head"))
    elif scorer == "partial_ratio":  # the shorter text's prefix
        meet = (((F.col("q.size") <= F.col("d.size")) & F.col("q.head")) | ((F.col("q.size") >= F.col("d.size")) & F.col("d.head")))
    else:
        meet = F.lit(True)
    met = q.join(d, [*same, meet]).select(F.col(f"q.{group}").alias(group), F.col("q.text").alias("_q"), F.col("d.text").alias("_c")).distinct()

    keep = ["form", "words", "size", "chars"]
    side = lambda t, name, p: t.select(group, F.col("text").alias(name), *[F.col(k).alias(f"{p}_{k}") for k in keep])
    full = lambda i: i.dropDuplicates([group, "text"])
    pairs = met.join(side(full(qi), "_q", "q"), [group, "_q"]).join(side(full(ci), "_c", "c"), [group, "_c"])
    common = F.size(F.array_intersect("q_chars", "c_chars"))
    if scorer == "token_set_ratio":
        held = F.aggregate(F.array_intersect("q_words", "c_words"), F.lit(0), lambda n, w: n + F.length(w) + 1)
        pairs = pairs.where((common >= c / 2 * (F.col("q_size") + F.col("c_size")) - EPS)
                            | (held >= c / (2 - c) * (F.least("q_size", "c_size") + 1) - EPS))
    elif scorer == "partial_ratio":
        pairs = pairs.where(common >= c / (2 - c) * F.least("q_size", "c_size") - EPS)
    return met, pairs


def fuzzy_join(queries: DataFrame, cands: DataFrame, group: str, q_text: str, c_text: str, order: str,
               scorer: str, cutoff: float, n: int | None = 3, process: bool = False) -> DataFrame:
    """Returns (group, q_text, rank, c_text, order, score) with score = round(raw/100, 4) >= cutoff/100
    (``order`` omitted when it is the candidate text itself)."""
    score = {"token_set_ratio": lambda: S.token_set_of(F.col("q_words"), F.col("c_words")),
             "partial_ratio": lambda: S.partial_ratio(F.col("q_form"), F.col("c_form")),
             "wratio": lambda: S.weighted_ratio(F.col("q_form"), F.col("c_form"))}[scorer]()
    c = cands.select(group, F.col(c_text).alias("_c"), F.col(order).alias("_o")).where(F.col("_c").isNotNull())
    _, pairs = candidate_pairs(_texts(queries, group, q_text, process), _texts(cands, group, c_text, process), group, scorer, cutoff)
    # few bytes but much work a row: dealt to a fixed number of tasks, which isn't reduced by size
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "_q", "_c")
    scored = pairs.select(group, "_q", "_c", score.alias("_raw")).where(F.col("_raw") >= F.lit(float(cutoff)))
    # every candidate row carrying that text is ranked (duplicated texts keep their own order)
    scored = scored.join(c, [group, "_c"]).withColumn("score", F.bround(F.col("_raw") / 100.0, 4))
    w = Window.partitionBy(group, "_q").orderBy(F.desc("_raw"), F.asc("_o"))
    out = scored.withColumn("rank", F.row_number().over(w))
    if n is not None:
        out = out.where(F.col("rank") <= n)
    cols = [group, F.col("_q").alias(q_text), "rank", F.col("_c").alias(c_text)]
    if order != c_text:
        cols.append(F.col("_o").alias(order))
    return out.select(*cols, "score")
