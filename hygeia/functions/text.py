"""Text predicates and normalisations used by validation and scoring.

All functions return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside the JVM (and whole-stage codegen where Spark allows it).
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace removed by Python's str.strip(): every code point whose
# str.isspace() is true (derived by rule, not listed by hand).
PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Fixed values (must equal the reference's behaviour):
# - validation treats exactly these texts as empty
EMPTY_TEXTS = ["", "nan"]
# - type inference ignores these (compared lower-cased), besides ""
INFER_IGNORED = ["none", "nan", "null"]
# - record signatures drop these tokens (compared lower-cased)
SIGNATURE_IGNORED = ["", "none", "null", "nan", "-", "na", "n/a", "undefined"]
# - text accepted by Python int(): optional sign, digits, single underscores between digits
INT_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*$"

INTEGER = "INTEGER"
STRING = "STRING"


def py_strip(c: Column) -> Column:
    """``str.strip()`` over all Unicode whitespace (Spark ``trim`` only drops spaces)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def is_int_text(c: Column) -> Column:
    return c.rlike(INT_PATTERN)


def canon_int(c: Column) -> Column:
    """Canonical text of ``int(s)`` for text matching INT_PATTERN (no 64-bit limit)."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[+\-_]", ""), r"^0+(?=[0-9])", "")
    neg = c.startswith("-") & (digits != "0")
    return F.when(neg, F.concat(F.lit("-"), digits)).otherwise(digits)


def normalize_value(stripped: Column, is_integer: Column) -> Column:
    """Type-driven normalisation: INTEGER fields get canonical integers, else the stripped text."""
    return F.when(is_integer & is_int_text(stripped), canon_int(stripped)).otherwise(stripped)


def is_empty(c: Column) -> Column:
    return c.isin(*EMPTY_TEXTS)


def default_process(c: Column) -> Column:
    """Scorer preprocessing: lower-case, non-word characters to spaces, trim."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\W", " "))


def signature(parts: Column) -> Column:
    """Record signature: non-ignored parts joined by a space, lower-cased."""
    kept = F.filter(parts, lambda x: ~F.lower(x).isin(*SIGNATURE_IGNORED))
    return F.lower(F.array_join(kept, " "))


def canon_type_name(c: Column) -> Column:
    """Type canonicalisation applied to masterlist types (and mappings, deviation D9)."""
    return F.when(c == "InstanceType", F.lit("instanceType")).otherwise(c)


def canon_param_name(c: Column) -> Column:
    """Metadata parameter names with a fixed spelling."""
    lc = F.lower(c)
    return (F.when(lc == "benchmarktype", F.lit("BenchmarkType"))
            .when(lc == "cloudprovider", F.lit("cloudProvider"))
            .otherwise(c))
