"""A corpus pipeline of five stages over ``documents``; each reads what the one before has written.

Quality classifier, line dedup, n-gram Jaccard join, mixing to target weights,
packing. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common, jaccard_join, line_dedup, mixing, packing, quality
from lumenframe.llm.common import table
from lumenframe.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 go."""
    ranker = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(COLUMNS), ranker)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later repeated windows go; documents stay, with what is left of them."""
    clean = line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose id names it."""
    groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = groups.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words have no weight and stay as they are."""
    return mixing.repeat_rows(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, *vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Random rounding and tokenizing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it; what a stage wrote on its way goes then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = len(common.WRITTEN)
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_written(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
