"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

Each works on all that the stage before kept. Null and empty texts, repeated rows, null ids and empty tables have the
results that the operators' docstrings state; all stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import line_dedup, near, packing, quality, secrets
from scorewright.llm.common import shared_dir
from scorewright.llm.queries import WORD_BPE


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is (null for a null text)."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of its input, takes for good and not toxic."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of lines that stand earlier in the corpus."""
    return _measured(line_dedup.drop_repeated_lines(docs).select(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts that have 0.8 or more of their five-word shingles in common."""
    return near.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return _measured(secrets.redact_secrets(docs, secrets.default_model(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return packing.pack(docs, WORD_BPE, window=2048, end_id=1)


STAGES = [("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
