"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread.

Language ID drops what the calibrated classifier rejects; line dedup drops lines that ten
documents or more share; the n-gram Jaccard join keeps one document of each group of
near copies; decontamination drops documents that hold a benchmark passage; mixing
replicates documents so that sources have equal shares. All but the last return the
columns of `documents`.

Defined cases: null text and text without a letter are rejected by language ID, so they
go; a text that loses all its lines stays, empty; repeated rows are documents of their own
until the join keeps one; null sources are mixed as one source; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import blocks, decontaminate, jaccard_join, language_id, line_dedup, mixing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, usable=language_id.fold(F.col("doc_id"), 5) != 0)
    return language_id.identify(docs, model).where("lang_accepted").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, min_docs=10)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_copies(docs, words=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
]

#: The language classifier is trained, so SQL cannot express the rows; tests compare each later stage with a brute-force version of it on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks.use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
