"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

python corpus_pipeline.py SF_DIR OUT_DIR runs it."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from graphloom.llm.common import read, shared_folder
from graphloom.llm.queries import MIX_WEIGHTS
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken once at most, for 60 % of all tokens."""
    return mixing.mix_rows(docs, share=0.6, weights=MIX_WEIGHTS, epochs=1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained and hashed stages have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus_pipeline").getOrCreate()
    run(session, sys.argv[1]).write.parquet(sys.argv[2])
