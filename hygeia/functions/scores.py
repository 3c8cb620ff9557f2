"""Text scores of the fuzzy joins as column expressions (F5-F7, F9), 0..100, defined in SURVEY 2.10.1.

Everything rests on the length of the longest common subsequence (LCS). Its bit-parallel form keeps one bit a character of
the shorter text; here the bits lie in several words of ``WORD`` bits, so there is no limit on lengths: the sum inside a step
carries from word to word. ``aggregate`` runs over the characters of the other text, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word: a sum of two words and a carry stays inside a BIGINT.
WORD = 60
_FULL = (1 << WORD) - 1


def _long(c) -> Column:
    return F.lit(c).cast("bigint")


def let(value: Column, body) -> Column:
    """``body`` of a value worked out once (lambdas work out whole columns again for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letters(s: Column) -> Column:
    """The characters of a text (none of an empty one)."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", _long(1), i.cast("int"))


def masks(chars: Column) -> Column:
    """For each character of an array of characters, words with a bit at each of its places: MAP<char, ARRAY<BIGINT>>."""
    def of(chars: Column) -> Column:
        words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(chars) - 1) / WORD).cast("int")))
        marked = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("i")))

        def own(found: Column) -> Column:
            return F.transform(words, lambda w: F.aggregate(
                found, _long(0), lambda acc, x: F.when(F.floor(x["i"] / WORD) == w, acc.bitwiseOR(_bit(x["i"] % WORD))).otherwise(acc)))

        return let(marked, lambda marked: let(F.array_distinct(chars), lambda each: F.map_from_arrays(
            each, F.transform(each, lambda c: let(F.filter(marked, lambda x: x["c"] == c), own)))))

    return let(chars, of)


def _step(state: Column, mask: Column) -> Column:
    """One character: V = (V + (V & M)) | (V & ~M), word by word with the carry of the sums."""
    def word(acc: Column, vm: Column) -> Column:
        u, v = vm["v"].bitwiseAND(vm["m"]), vm["v"]
        new = lambda total: F.struct(
            F.concat(acc["out"], F.array(total.bitwiseAND(_long(_FULL)).bitwiseOR(v - u))).alias("out"),
            F.call_function("shiftright", total, F.lit(WORD)).alias("carry"))
        return let(v + u + acc["carry"], new)

    start = F.struct(F.array().cast("array<bigint>").alias("out"), _long(0).alias("carry"))
    return F.aggregate(F.zip_with(state, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), start, word, lambda s: s["out"])


def lcs_letters(size: Column, masks: Column, other: Column) -> Column:
    """LCS of the text of ``size`` characters behind ``masks`` with an array of characters. Bits beyond the text are never
    cleared, so the zeros count what matched. A text of one word needs no carry."""
    one = F.aggregate(other, _long(_FULL), lambda v, c: F.coalesce(
        (v + v.bitwiseAND(masks[c][0])).bitwiseAND(_long(_FULL)).bitwiseOR(v - v.bitwiseAND(masks[c][0])), v))
    start = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / WORD).cast("int")), lambda _: _long(_FULL))
    many = F.aggregate(other, start, lambda v, c: F.when(masks[c].isNull(), v).otherwise(_step(v, masks[c])))
    return (F.when((size == 0) | (F.size(other) == 0), 0).when(size <= WORD, WORD - F.bit_count(one))
            .otherwise(F.aggregate(many, F.lit(0), lambda n, v: n + F.lit(WORD) - F.bit_count(v))))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts of any lengths."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return let(letters(short), lambda s: let(masks(s), lambda m: lcs_letters(F.size(s), m, letters(long))))


def _share(distance: Column, size: Column) -> Column:
    return F.when(size == 0, 100.0).otherwise(100.0 * (1.0 - distance / size))


def ratio(a: Column, b: Column) -> Column:
    """100 (1 - d / (|a| + |b|)), d = |a| + |b| - 2 LCS; two empty texts: 100."""
    size = F.length(a) + F.length(b)
    return _share(size - 2 * lcs(a, b), size)


def _windows(needle: Column, hay: Column) -> Column:
    """The greatest ratio of ``needle`` with a window of ``hay`` (characters): every start, and prefixes and suffixes shorter than the needle."""
    def best(m: Column, n: Column, masks_: Column, hay: Column) -> Column:
        def at(p: Column) -> Column:
            low = F.greatest(p, F.lit(1))
            return let(F.slice(hay, low, F.least(p + m - 1, n) - low + 1),
                       lambda w: _share(m + F.size(w) - 2 * lcs_letters(m, masks_, w), m + F.size(w)))

        return F.array_max(F.transform(F.sequence(2 - m, n), at))

    return let(needle, lambda s: let(masks(s), lambda k: let(hay, lambda t: best(F.size(s), F.size(t), k, t))))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best window of the longer text for the shorter one; equal lengths: either may be cut; an empty text: 0."""
    la, lb = F.length(a), F.length(b)
    return (F.when((la == 0) | (lb == 0), 0.0).when(F.contains(a, b) | F.contains(b, a), 100.0)
            .when(la < lb, _windows(letters(a), letters(b))).when(la > lb, _windows(letters(b), letters(a)))
            .otherwise(F.greatest(_windows(letters(a), letters(b)), _windows(letters(b), letters(a)))))


def tokens(s: Column) -> Column:
    """The distinct words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Scores of the words common to both and of what each has besides (see ``token_set_of``)."""
    return token_set_of(tokens(a), tokens(b))


def token_set_of(ta: Column, tb: Column) -> Column:
    """The token-set score of two sorted sets of words: 0 if one is empty, 100 if one holds the other; else the greatest of: common + rest
    against common + rest (the distance is that of the rests), common against common + rest of either side."""
    def score(common: Column, a: Column, b: Column) -> Column:
        gap = F.when(common > 0, 1).otherwise(0)
        sa, sb = common + gap + F.length(a), common + gap + F.length(b)
        alone = F.greatest(*[_share(gap + F.length(x), common + s) for x, s in ((a, sa), (b, sb))])
        bound = F.length(a) + F.length(b) - 2 * F.least(F.length(a), F.length(b))
        rests = F.when((common > 0) & (alone >= _share(bound, sa + sb)), alone).otherwise(
            _share(F.length(a) + F.length(b) - 2 * lcs(a, b), sa + sb))
        return F.when((common > 0) & ((a == "") | (b == "")), 100.0).when(common == 0, rests).otherwise(F.greatest(rests, alone))

    found = let(F.length(F.array_join(F.array_intersect(ta, tb), " ")), lambda common: let(
        F.array_join(F.array_except(ta, tb), " "), lambda a: let(F.array_join(F.array_except(tb, ta), " "), lambda b: score(common, a, b))))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(found)


def _sorted_words(s: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")), " ")


def weighted_ratio(a: Column, b: Column) -> Column:
    """Lengths within 1.5: the greater of ratio and 0.95 x the token scores. Else partial scores count 0.9 (0.6 where one text is over 8 times
    as long), those of the words 0.95 of that. An empty text: 0."""
    la, lb = F.length(a), F.length(b)
    times = F.greatest(la, lb) / F.least(la, lb)
    wa, wb = _sorted_words(a), _sorted_words(b)
    words = F.greatest(ratio(wa, wb), token_set_ratio(a, b))
    scale = F.when(times <= 8, 0.9).otherwise(0.6)
    wordless = (wa == "") | (wb == "")
    part = F.when(wordless, 0.0).when(F.arrays_overlap(tokens(a), tokens(b)), 100.0).otherwise(partial_ratio(wa, wb))
    return (F.when((la == 0) | (lb == 0), 0.0)
            .when(times < 1.5, F.greatest(ratio(a, b), words * 0.95))
            .otherwise(F.greatest(ratio(a, b), partial_ratio(a, b) * scale, part * 0.95 * scale)))
