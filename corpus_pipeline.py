"""The corpus pipeline: five operators one after another over the documents table.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns a DataFrame; run() writes
it as Parquet in the shared folder and rereads it, and deletes what the stage before has left. All stages but the last
return the columns of documents. A stage begins with giving back what the one before holds on the driver.

Defined results: null and empty texts are scored as documents without words, are copies of each other, cover nothing, hold
no secrets and have no words to mix; repeated rows are one; ties go to the smallest doc_id; without documents nothing is
left; further columns pass through all stages, and those named as the last one's results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import decontam, mixing, neardup, quality, secrets
from weirflow.llm.common import release, stage, temporary, tidy


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go."""
    tidy(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies stays."""
    tidy(spark)
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    tidy(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked."""
    tidy(spark)
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with size, source_size, target and taken, where taken is above 0."""
    tidy(spark)
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing", mixing_stage),
]

#: A trained network, samples and tilings: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with temporary() as made:
            out = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            made.remove(out)
        release(docs)
        docs = out
    return docs
