"""A training corpus from `documents`: quality, near-duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows: see the operators; every stage takes nulls,
empty texts, repeated rows and an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, minhash_dedup, mixing, quality, sharding
from quire.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.ACCEPT).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id; rows without one all stay."""
    return minhash_dedup.remove_near_duplicates(docs).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth is benchmark passages go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with their rate as probability, none twice, so that no domain has more than its weight.

    The rates lie in 0..1 and are fitted as such. Relative to the clean tokens that stay, a domain above its weight comes
    down to it in expectation; one below it keeps what it has. Clean documents stay.
    """
    labels = mixing.domain_of(table(spark, sf_dir, "labels"))
    return mixing.thin(docs, labels, mixing.WEIGHTS, "clean").select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mixing_stage),
    ("shard", sharding_stage),
]

#: A learned classifier decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table. A stage's output goes when the next one's has been written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
