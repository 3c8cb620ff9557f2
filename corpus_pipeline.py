"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes the documents that its predecessor kept and returns the
documents it keeps, in the columns of ``documents`` (n_chars follows the text);
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygeia.llm.common import Scratch
from hygeia.llm.minhash import near_dedup
from hygeia.llm.mixing import mixed_documents
from hygeia.llm.packing import pack_documents
from hygeia.llm.quality import judge
from hygeia.llm.queries import vocabulary
from hygeia.llm.substring import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a rule of the cascade rejects go."""
    return judge(docs).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup(docs).select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents without a word left go."""
    cut = substring_dedup(docs).where("n_removed < n_words").drop("n_chars")
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_duplicates), ("substring_dedup", substrings),
          ("source_mixing", mixture), ("best_fit_packing", packing)]

#: SQL can't express the tokenizer nor the samples; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
