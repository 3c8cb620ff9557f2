"""Keyed upserts and document overlays.

Table formats with row-level MERGE are not assumed; an upsert is a
left-anti join of the current table with the changed keys plus the new rows,
written to a fresh path (readers switch to the new version).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows of ``current`` with the same key; others are kept."""
    kept = current.join(changes.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(changes.select(*current.columns))


def write_version(df: DataFrame, base: str, version: str) -> str:
    """Write a table version to ``base/version=<v>`` (append-only history of table states)."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def append(df: DataFrame, path: str) -> None:
    """Append rows (e.g. drafted masterlist records)."""
    df.write.mode("append").parquet(path)


def _trie(paths: list[str], names: set[str]) -> dict:
    """Nested dict of path segments; a dotted path that is a top-level key stays one segment as well as its nested form."""
    root: dict = {}
    for p in paths:
        for segs in ([[p]] if p in names else []) + ([p.split(".")] if "." in p or p not in names else []):
            node = root
            for s in segs[:-1]:
                node = node.setdefault(s, {})
                if not isinstance(node, dict):
                    break
            else:
                node[segs[-1]] = p
    return root


def _overlay(col: Column | None, dt, trie: dict, new: Column) -> Column:
    """``col`` (a struct, or nothing yet) with the values of ``new`` (map path -> text) at the leaves of ``trie``;
    a leaf keeps its own type, missing levels are created."""
    from pyspark.sql import types as PT
    have = {f.name: f for f in dt.fields} if isinstance(dt, PT.StructType) else {}
    out = []
    for name in [*have, *(k for k in trie if k not in have)]:
        old = col.getField(name) if col is not None and name in have else None
        want = trie.get(name)
        kind = have[name].dataType if name in have else None
        if want is None:
            c = old
        elif isinstance(want, dict):
            c = _overlay(old if isinstance(kind, PT.StructType) else None, kind, want, new)
        else:
            v = new[F.lit(want)]
            c = v if old is None else F.when(F.array_contains(F.map_keys(new), want), v.try_cast(kind)).otherwise(old)
        out.append(c.alias(name))
    return F.struct(*out)


def _set_json(docs, updates):
    """JSON texts with values put at dotted paths: the literal key where there is one, and the nested place."""
    import json
    out = []
    for doc, ups in zip(docs, updates):
        d = json.loads(doc) if doc else {}
        for path, value in ups or []:
            if path in d:
                d[path] = value
            node, segs = d, path.split(".")
            for s in segs[:-1]:
                if not isinstance(node.get(s), dict):
                    node[s] = {}
                node = node[s]
            node[segs[-1]] = value
        out.append(json.dumps(d))
    return out


def apply_document_updates(executions: DataFrame, updates: DataFrame, doc: str = "doc",
                           id_col: str = "exec_id") -> DataFrame:
    """Set ``doc.<path> = value`` for update rows (exec_id, path, value and, for their order, seq).

    The last update per (id, path) by ``seq`` wins (without seq: the largest value).  STRUCT documents keep the
    type of each leaf and gain the levels they lack; VARIANT and JSON texts are edited as JSON.  Only changed
    executions are rewritten; the others are passed on.
    """
    from pyspark.sql import types as PT
    order = F.col("seq") if "seq" in updates.columns else F.col("value")
    u = updates.groupBy(id_col, "path").agg(F.max_by("value", order).alias("value"))
    dt = executions.schema[doc].dataType
    per = u.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_new"))
    j = executions.join(per, id_col, "left")
    if isinstance(dt, PT.StructType):
        # the paths of rule mappings: they shape the document's type
        paths = sorted(r["path"] for r in u.select("path").distinct().collect())
        if not paths:
            return executions
        trie = _trie(paths, {f.name for f in dt.fields})
        new = F.coalesce("_new", F.create_map().cast("map<string,string>"))
        return j.withColumn(doc, _overlay(F.col(doc), dt, trie, new)).drop("_new")
    @F.pandas_udf("string")
    def edited(docs: pd.Series, ups: pd.Series) -> pd.Series:
        pairs = [None if p is None else [(x["path"], x["value"]) for x in p] for p in ups]
        return pd.Series(_set_json(docs, pairs))

    text = F.to_json(doc) if isinstance(dt, PT.VariantType) else F.col(doc)
    entries = F.transform(F.map_entries("_new"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
    changed = j.where(F.col("_new").isNotNull()).withColumn("_t", edited(text, entries))
    changed = changed.withColumn(doc, F.try_parse_json("_t") if isinstance(dt, PT.VariantType) else F.col("_t"))
    rest = executions.join(per.select(id_col), id_col, "left_anti")
    return rest.unionByName(changed.select(*executions.columns))
