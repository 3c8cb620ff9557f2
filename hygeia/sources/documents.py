"""Free-form JSON documents of the two input collections -> the tables of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygeia.functions import paths as P

#: Keys of a masterlist record that may hold its id, in order (fixed values).
RECORD_IDS = ["`_id`", "id", "_id"]


def masterlist(documents: DataFrame, doc: Column, ordinal: Column) -> DataFrame:
    """Masterlist rows of JSON records held as VARIANT.  The id is the first of three keys that has a value, ``{"$oid": x}``
    meaning x; metadata that are no object count as absent, and their values as text."""
    found = P.node_at(doc, "data.metadata")
    entries = F.when(F.schema_of_variant(found).startswith("OBJECT"), F.try_variant_get(found, "$", "map<string,string>"))
    return documents.select(
        ordinal.cast("bigint").alias("ordinal"), P.first_id(doc, RECORD_IDS).alias("ml_id"),
        F.try_variant_get(doc, "$.type", "string").alias("type"), F.try_variant_get(doc, "$.status", "string").alias("status"),
        F.struct(F.try_variant_get(doc, "$.data.value", "string").alias("value"),
                 F.try_variant_get(doc, "$.data.mapping", "string").alias("mapping"), entries.alias("metadata")).alias("data"))


def execution_id(doc: Column) -> Column:
    """The document's benchmarkExecutionID; only where the key is missing, its ``_id``."""
    own = P.node_at(doc, "benchmarkExecutionID")
    return F.when(own.isNotNull(), F.try_variant_get(own, "$", "string")).otherwise(P.first_id(doc, ["_id"]))


def executions(documents: DataFrame, doc: Column) -> DataFrame:
    """(exec_id, doc, benchmarkType, benchmarkCategory, createdOn) of JSON documents held as VARIANT."""
    text = lambda k: F.try_variant_get(doc, f"$.{k}", "string").alias(k)
    return documents.select(execution_id(doc).alias("exec_id"), doc.alias("doc"), text("benchmarkType"),
                            text("benchmarkCategory"), text("createdOn"))
