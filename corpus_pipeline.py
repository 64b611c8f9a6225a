"""A corpus from documents to packed sequences, stage by stage, each one an operator of tidegrid.llm.

Every stage works on all rows that the one before kept and returns the columns of documents, the last one packed pieces.
Texts of any length are read whole. Other columns come along unchanged, whatever their names; repeated rows are rows of
their own, except where a stage says so. Missing values are dealt with as each stage says; of an empty table each stage
makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, jaccard, packing, quality, substring
from tidegrid.llm.common import passing, scratch, stored

#: A byte of a word, as the substring stage tells words apart.
WORD = r"[^\x20\x09-\x0D]"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like others, as texts without words."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (of such, the first one read); a missing
    doc_id comes before all others. Documents without words are near no other and all stay."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows, a text that had words and lost them all goes."""
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    left = substring.without_repeats(docs.withColumn("__worded", worded))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).where(worded | ~F.col("__worded")).select(*[F.col(f"`{c}`") for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts have none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and where they stand; a null or empty text is its end token alone."""
    return packing.packed(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("substrings", without_repeats), ("decontamination", clean), ("packing", sequences)]

#: SQL has no form of the trained model, the tokenizer or the linear program; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark)
    for name, stage in STAGES:
        with passing(spark):  # what a stage keeps for itself goes once its rows are written
            docs = stored(stage(spark, docs, sf_dir), f"{base}/{name}")
    return docs
