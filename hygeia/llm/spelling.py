"""Spelling variants: words one edit apart, found by asymmetric q-chunks, grouped under the form that is used more.

Of two words at most one code point apart in length the shorter one (of equal lengths: the smaller) gives two disjoint chunks,
its first half (rounded up) and the rest; the other gives its positional grams of those lengths. One edit spoils at most one
chunk, so the other stands in the longer word within a shift of one: the first chunk at its own place, the last one shifted by the
difference of lengths. Grams at other places can't meet a chunk and aren't made. Short chunks are shared by
very many words, so the rest of a word is cut by the same rule once more: a key is a chunk together with a chunk of
the rest, about three quarters of the word, and no group of words grows with a frequent half. Keys are joined as 64-bit
hashes; every candidate is verified by its edit distance, so a collision costs time only. Words are few bytes in a compressed
file and many in a hash table, and keys are several a word, so Spark takes them for smaller than they are: no join here is by broadcast.

A word's form is its near word of the largest count, if that is at least ``ratio`` times its own; a chain of forms at least
doubles its count at each step, so it has at most log2(count) steps and pointer doubling settles it in the logarithm of those.

Cases: a null or empty text has no words; a null doc_id is written as nothing; words are compared by code points; equal counts take the
smaller word; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.llm.common import Scratch

RUN = r"[A-Za-zÀ-ÿ]+"
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Characters of a text above which its words are counted one by one and not listed.
LONG = 1 << 22


def word_counts(docs: DataFrame, least: int = 5, spoil: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters of at least ``least`` code points, A-Z in lower case. ``spoil``: where it divides the crc32 h of
    ``<doc_id>:<run>``, the run loses its code point h % length first."""
    def count(batches):
        run, held = re.compile(RUN), {}

        def put():
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return b

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                low = text.encode().lower().decode()  # of bytes: A-Z only
                found = Counter((m[0] for m in run.finditer(low)) if len(low) > LONG else run.findall(low))
                start = doc_id.as_py()
                before = zlib.crc32(f"{'' if start is None else start}:".encode())
                for word, n in found.items():
                    if spoil:
                        h = zlib.crc32(word.encode(), before)
                        if h % spoil == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield put()
        if held:
            yield put()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _cut(x: Column, length: Column) -> list[tuple[str, Column, Column]]:
    """(side, piece, rest) of a text that is to meet one of ``length`` code points: its first half, its last."""
    last = F.floor(length / 2).cast("int")
    first = length - last
    return [("a", F.substring(x, F.lit(1), first), F.substring(x, first + 1, F.char_length(x))),
            ("b", F.right(x, last), F.left(x, F.char_length(x) - last))]


def _keys(word: Column, length: Column) -> list[Column]:
    """The keys of ``word`` against words of ``length`` code points: a half and a half of the rest."""
    out = []
    last = F.floor(length / 2).cast("int")
    for side, piece, rest in _cut(word, length):
        for side2, piece2, _ in _cut(rest, last if side == "a" else length - last):
            out.append(F.xxhash64(length, F.lit(side + side2), piece, piece2))
    return out


def near_words(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n, near, near_n) of all pairs of ``words`` (word, n) that differ by one inserted, deleted or replaced code point, both ways."""
    w, size = F.col("word"), F.char_length("word")
    chunks = words.select(F.explode(F.array(*_keys(w, size))).alias("key"), w.alias("u"), F.col("n").alias("un"))
    longer = F.when(size > least, F.array(*_keys(w, size - 1))).otherwise(F.array().cast("array<bigint>"))
    grams = words.select(F.explode(F.concat(F.array(*_keys(w, size)), longer)).alias("key"), w.alias("v"), F.col("n").alias("vn"))
    order = (F.char_length("u") < F.char_length("v")) | ((F.char_length("u") == F.char_length("v")) & (F.col("u") < F.col("v")))
    pairs = chunks.join(grams.hint("merge"), "key").where(order & (F.levenshtein("u", "v", 1) == 1)).select("u", "un", "v", "vn").distinct()
    return (pairs.select(F.col("u").alias("word"), F.col("un").alias("n"), F.col("v").alias("near"), F.col("vn").alias("near_n"))
            .unionByName(pairs.select(F.col("v").alias("word"), F.col("vn").alias("n"), F.col("u").alias("near"), F.col("un").alias("near_n"))))


def _roots(forms: DataFrame, work: Scratch) -> DataFrame:
    """(word, root) for each (word, form): the end of its chain of forms, by pointer doubling."""
    up, step = forms.select("word", F.col("form").alias("root")), 0
    while True:
        on = up.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        up = work.table(up.join(on.hint("merge"), F.col("root") == F.col("_at"), "left")
                        .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"roots{step}")
        step += 1
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = 2, least: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each (word, n) of ``words`` (distinct words of at least ``least`` code points)."""
    work = Scratch(words.sparkSession, "spelling")
    words = work.table(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = (near_words(words, least).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
             .select("word", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form"),
                     F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n")))
    found = work.table(found, "near")
    roots = _roots(found.where("form is not null"), work)
    return (words.join(found.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"))


def spelling_variants(docs: DataFrame, least: int = 5, often: int = 3, ratio: int = 2, spoil: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of ``docs`` with at least ``least`` code points and ``often`` occurrences."""
    return variant_groups(word_counts(docs, least, spoil).where(F.col("n") >= often), ratio, least)
