"""String similarity scores as Spark column expressions.

``ratio`` (F5) is the normalised indel similarity 2*LCS/(|a|+|b|).  LCS uses a
bit-parallel recurrence (Hyyro / Allison-Dix) over a BIGINT state for strings up
to 62 characters; longer pairs use the same recurrence over a state of several
words (scores.py).  Both run JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.functions.scores import lcs
from hygeia.session import materialize, sized_broadcast

MAX_SQL_LCS = 62
#: A pair of texts on more rows than this is joined by broadcast when the table of all pairs is too large for it.
HOT_ROWS = 100_000


def lcs_sql(a: Column, b: Column) -> Column:
    """LCS length of ``a`` and ``b`` where 1 <= len(a) <= 62 (JVM-side)."""
    m = F.length(a)
    one = F.lit(1).cast("bigint")
    full = F.call_function("shiftleft", one, m) - one
    chars = F.split(b, "")
    masks = F.transform(chars, lambda ch: F.aggregate(
        F.sequence(F.lit(0), m - 1), F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.when(F.substring(a, i + 1, 1) == ch, F.call_function("shiftleft", one, i))
                                     .otherwise(F.lit(0).cast("bigint")))))
    v = F.aggregate(masks, full, lambda v, mk: (v + v.bitwiseAND(mk)).bitwiseOR(v - v.bitwiseAND(mk)).bitwiseAND(full))
    return m - F.bit_count(v)


def _ratio_from(lcs: Column, a: Column, b: Column) -> Column:
    return F.bround(F.lit(2.0) * lcs / (F.length(a) + F.length(b)), 4)


def ratio_short(a: Column, b: Column) -> Column:
    """F5 for pairs whose shorter side has <= 62 characters; callers guard empties."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return _ratio_from(lcs_sql(shorter, longer), a, b)


def with_ratio(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out`` = round(ratio(a, b), 4), 0.0 when either side is empty or NULL.

    The score is computed once per distinct (a, b) pair and joined back: rows
    repeat the same few value pairs, so the LCS work is bounded by distinct
    pairs, not rows.  Pairs whose shorter side exceeds 62 characters take the
    expression over several words.  The scored pairs are written once and broadcast when their measured
    size allows; else by broadcast go only those on more than ``HOT_ROWS`` rows, so that no task gets all rows of a frequent pair.
    """
    ca, cb = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    empty = (F.length(ca) == 0) | (F.length(cb) == 0)
    # rows with an empty side score 0 without a partner: their keys match nothing and are spread over all tasks
    plain = [F.col(c) for c, t in df.dtypes if "map<" not in t and t != "variant"]
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*plain), F.lit(1024)).cast("string"))
    df2 = df.withColumn("_ra", F.when(empty, spread).otherwise(ca)).withColumn("_rb", F.when(empty, F.lit("")).otherwise(cb))
    pairs = materialize(df2.where(F.col("_rb") != "").groupBy("_ra", "_rb").agg(F.count(F.lit(1)).alias("_n")), "ratio_pairs")
    pa, pb = F.col("_ra"), F.col("_rb")
    is_long = F.least(F.length(pa), F.length(pb)) > MAX_SQL_LCS
    short = pairs.where(~is_long).withColumn(out, ratio_short(pa, pb))
    long_ = pairs.where(is_long).withColumn(out, _ratio_from(lcs(pa, pb), pa, pb))
    scored = materialize(short.unionByName(long_), "ratio_scores")
    key, all_pairs = ["_ra", "_rb"], scored.drop("_n")
    small = sized_broadcast(all_pairs)
    if small is not all_pairs:
        j = df2.join(small, key, "left")
    else:
        hot = scored.where(F.col("_n") > HOT_ROWS).select(*key, F.col(out).alias("_hot"))
        df2 = df2.join(F.broadcast(hot), key, "left")
        found = F.col("_hot").isNotNull()
        df2 = df2.withColumn("_ra", F.when(found, spread).otherwise(F.col("_ra"))).withColumn("_rb", F.when(found, F.lit("")).otherwise(F.col("_rb")))
        rest = scored.where(F.col("_n") <= HOT_ROWS).drop("_n")
        j = df2.join(rest, key, "left").withColumn(out, F.coalesce("_hot", F.col(out))).drop("_hot")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0.0))).drop(*key)
