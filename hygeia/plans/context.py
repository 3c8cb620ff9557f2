"""One hygiene run over a directory of driver tables: fixture views, rules, validation.

Objects are memoised per (session, directory) so the registered queries of one
session share the rule derivation and the validated table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygeia.plans import rules as R
from hygeia.plans import validate as V
from hygeia.session import materialize
from hygeia.sources import fixtures as FX

_CACHE: dict = {}


class HygieneRun:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    @cached_property
    def masterlist(self) -> DataFrame:
        # read by every rule table and many queries: derived from its tables once
        return materialize(FX.masterlist(self.spark, self.sf_dir), "masterlist")

    @cached_property
    def executions(self) -> DataFrame:
        return FX.executions(self.spark, self.sf_dir)

    @cached_property
    def processor(self) -> DataFrame:
        return FX.processor_details(self.spark, self.sf_dir)

    @property
    def doc(self):
        return F.col("doc")

    @cached_property
    def rules(self) -> R.RuleSet:
        rules = R.build_rules(self.masterlist, self.executions, self.doc, self.processor)
        # rule tables are small and reused by every plan below
        for name in ("records", "values", "configs", "signatures", "meta_values"):
            setattr(rules, name, getattr(rules, name).persist(StorageLevel.MEMORY_AND_DISK))
        if rules.processor is not None:
            rules.processor = rules.processor.persist(StorageLevel.MEMORY_AND_DISK)
        return rules

    @cached_property
    def meta_paths(self) -> list[str]:
        return V.metadata_paths(self.rules)

    @cached_property
    def validated(self) -> DataFrame:
        # reused by every report, the suggestions and the snapshot upsert
        # reports need ids, categories and verdicts: the documents themselves are not written again
        return materialize(V.validate(self.rules, self.executions, self.doc, meta_paths=self.meta_paths).drop("doc"),
                           "validated")


def run_for(spark: SparkSession, sf_dir: str) -> HygieneRun:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = HygieneRun(spark, sf_dir)
    return _CACHE[key]
