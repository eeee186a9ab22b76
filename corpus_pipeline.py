"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. The first three return rows of their input, whole; the last returns
token counts and digests per document. Documents with null or empty texts pass the first three
stages (they are scored as empty, equal nothing and hold no passage) and give the begin and end
ids alone; rows without doc_id are never dropped as copies or leaks. Empty tables pass through.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, near_dedup, sentencepiece_codec, toxicity
from assay.scratch import materialize

#: Rows that a Python worker gets at a time: whole texts are long, Spark's default is 10,000.
BATCH_ROWS = 1000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """Bounds the memory of the stages' Python workers; read when a stage is written."""
    spark.conf.set(ROWS_SETTING, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; fitted on the labels of what is there."""
    _short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # The whole row rides along under one name, so no column of it can clash.
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    return toxicity.score_documents(rows, labels).filter("predicted = 0").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    _short_batches(spark)
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    _short_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    _short_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_digests(docs, model, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]
#: Fitted trees and learned pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the caller's batch size is as before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(ROWS_SETTING, None)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        if before is None:
            spark.conf.unset(ROWS_SETTING)
        else:
            spark.conf.set(ROWS_SETTING, before)
    return docs
