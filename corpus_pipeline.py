"""From raw documents to packed training sequences, a stage per operator.

Each stage reads what the one before it wrote; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwatch.llm import language, lines, mixing, near_copies, packing
from poolwatch.llm.common import documents, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; others go."""
    return language.keep_known(docs, language.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go; n_chars follows the text."""
    cleaned = lines.dedup_lines(docs, counts=("_n_lines", "_n_removed"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.col("_n_removed") > 0, length).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(docs.columns)


def near_copy_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed token sequences."""
    return packing.pack(docs, packing.vocabulary()).drop("ids")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copy_join),
    ("mixing sources to target weights", mix_sources),
    ("packing", packing_stage),
]

# Trained models and tokenizers are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
