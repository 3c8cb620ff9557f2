"""Dotted-path lookup into free-form documents held as VARIANT.

Semantics: the whole dotted string as a literal top-level key wins (even when
it holds null); otherwise descend objects key by key; arrays are not traversed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from hygeia.functions.text import py_strip


def _q(seg: str) -> str:
    return "['" + seg.replace("\\", "\\\\").replace("'", "\\'") + "']"


def nested_json_path(path: str) -> str:
    return "$" + "".join(_q(s) for s in path.split("."))


def literal_json_path(path: str) -> str:
    return "$" + _q(path)


def to_doc_variant(doc: Column, kind: str) -> Column:
    """Turn a JSON string or a struct column into a VARIANT (malformed JSON -> NULL)."""
    if kind == "json":
        return F.try_parse_json(doc)
    if kind == "struct":
        return F.to_variant_object(doc)
    return doc


def node_at(v: Column, path: str) -> Column:
    """VARIANT node at ``path`` (SQL NULL when missing, variant null when JSON null)."""
    nested = F.try_variant_get(v, nested_json_path(path), "variant")
    if "." not in path:
        return nested
    literal = F.try_variant_get(v, literal_json_path(path), "variant")
    return F.when(literal.isNotNull(), literal).otherwise(nested)


def first_id(v: Column, keys: list[str]) -> Column:
    """Text of the first of the literal ``keys`` that a VARIANT document holds with a value; ``{"$oid": x}`` is x."""
    found = []
    for k in keys:
        oid = F.try_variant_get(v, literal_json_path(k) + _q("$oid"), "string")
        text = F.try_variant_get(v, literal_json_path(k), "string")
        found.append(F.when(oid.isNotNull(), oid).otherwise(F.nullif(text, F.lit(""))))
    return F.coalesce(*found)


def _text_from(t: Column, s: Column, d: Column) -> Column:
    """Python ``str()`` of a node from its variant type name ``t``, string form ``s``, double ``d``."""
    return (F.when(t == "BOOLEAN", F.when(s == "true", F.lit("True")).otherwise(F.lit("False")))
            .when((t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")) & (d == F.floor(d)),
                  F.concat(F.floor(d).cast("decimal(38,0)").cast("string"), F.lit(".0")))
            .otherwise(s))


def _falsy_from(t: Column, s: Column, d: Column) -> Column:
    return (F.when(t.isNull() | (t == "VOID"), F.lit(True))
            .when(t == "STRING", s == "")
            .when(t == "BOOLEAN", s == "false")
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), s.isin("[]", "{}"))
            .otherwise(F.coalesce(d == 0, F.lit(False))))


def _resolve_struct(dt: PT.StructType, path: str):
    """Column path and leaf type of ``path`` inside a struct schema (None when absent)."""
    names = {f.name: f for f in dt.fields}
    if "." in path and path in names:
        return [path], names[path].dataType
    cur, out = dt, []
    for seg in path.split("."):
        if not isinstance(cur, PT.StructType):
            return None
        fs = {f.name: f for f in cur.fields}
        if seg not in fs:
            return None
        out.append(seg)
        cur = fs[seg].dataType
    return out, cur


def _struct_text(c: Column, dt) -> tuple[Column, Column]:
    """(Python str() text, falsy flag) for a typed leaf column."""
    if isinstance(dt, PT.StringType):
        return c, c.isNull() | (c == "")
    if isinstance(dt, PT.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit("False")), c.isNull() | ~c
    if isinstance(dt, (PT.ByteType, PT.ShortType, PT.IntegerType, PT.LongType)):
        return c.cast("string"), c.isNull() | (c == 0)
    if isinstance(dt, (PT.FloatType, PT.DoubleType, PT.DecimalType)):
        d = c.cast("double")
        txt = F.when(d == F.floor(d), F.concat(F.floor(d).cast("decimal(38,0)").cast("string"), F.lit(".0"))) \
            .otherwise(d.cast("string"))
        return txt, c.isNull() | (d == 0)
    if isinstance(dt, (PT.ArrayType, PT.MapType)):
        return F.to_json(c), c.isNull() | (F.size(c) == 0)
    if isinstance(dt, PT.StructType):
        return F.to_json(c), c.isNull()
    return c.cast("string"), c.isNull()


def add_path_texts(df: DataFrame, doc: Column, paths: list[str], prefix: str = "_pv",
                   infer: bool = False, strip: bool = True) -> DataFrame:
    """Adds one text column per path: ``{prefix}{i}``.

    Validation text (default): ``str(get(doc, path) or '').strip()``.
    Inference text (``infer=True``): ``str(raw).strip()``; NULL when missing or null.  ``strip=False``: as it is.
    Built in staged projections (node, then type/string, then text) so each
    variant lookup runs once per row and generated code stays small.
    """
    trimmed = py_strip if strip else (lambda c: c)
    df = df.withColumn("_docv", doc)
    dt = df.schema["_docv"].dataType
    if isinstance(dt, PT.StructType):
        # typed documents: paths are resolved against the schema at plan time
        outs = []
        for i, p in enumerate(paths):
            hit = _resolve_struct(dt, p)
            if hit is None:
                txt = F.lit(None).cast("string") if infer else F.lit("")
            else:
                segs, leaf = hit
                c = F.col("_docv")
                for sg in segs:
                    c = c.getField(sg)
                t, falsy = _struct_text(c, leaf)
                if infer:
                    txt = F.when(c.isNull(), F.lit(None).cast("string")).otherwise(trimmed(t))
                else:
                    txt = F.when(falsy, F.lit("")).otherwise(F.coalesce(trimmed(t), F.lit("")))
            outs.append(txt.alias(f"{prefix}{i}"))
        return df.select("*", *outs).drop("_docv")
    df = df.select("*", *[node_at(F.col("_docv"), p).alias(f"__vn{i}") for i, p in enumerate(paths)]).drop("_docv")
    df = df.select("*", *[F.schema_of_variant(F.col(f"__vn{i}")).alias(f"__vt{i}") for i in range(len(paths))],
                   *[F.try_variant_get(F.col(f"__vn{i}"), "$", "string").alias(f"__vs{i}") for i in range(len(paths))],
                   *[F.try_variant_get(F.col(f"__vn{i}"), "$", "double").alias(f"__vd{i}") for i in range(len(paths))])
    outs = []
    for i in range(len(paths)):
        t, s_, d = F.col(f"__vt{i}"), F.col(f"__vs{i}"), F.col(f"__vd{i}")
        if infer:
            txt = F.when(t.isNull() | (t == "VOID"), F.lit(None).cast("string")).otherwise(trimmed(_text_from(t, s_, d)))
        else:
            txt = F.when(_falsy_from(t, s_, d), F.lit("")).otherwise(F.coalesce(trimmed(_text_from(t, s_, d)), F.lit("")))
        outs.append(txt.alias(f"{prefix}{i}"))
    drop = [f"__v{k}{i}" for i in range(len(paths)) for k in ("n", "t", "s", "d")]
    return df.select("*", *outs).drop(*drop)
