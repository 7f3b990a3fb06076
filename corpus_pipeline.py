"""From raw documents to packed training sequences, in five stages.

quality    rejects documents that the classifier predicts to be of low quality
minhash    keeps one document, that of the smallest id, of each group of near-duplicates
pii        replaces personal data by format-preserving pseudonyms
mixing     repeats or drops documents so that sources come near their target weights
packing    packs what is left into sequences

A stage reads documents as its predecessor left them, whole, and returns the columns of documents; the last returns
pieces of sequences. Each treats nulls, blank texts, repeats and empty tables as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import minhash, mixing, packing, pii, quality
from quern.llm.common import bounded, materialize

#: SQL cannot express the classifier, the pseudonyms and the packing; the stages are tested against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(minhash.near_duplicates(docs).where("not kept").select("doc_id"), "pipeline-duplicates")
    return docs.join(bounded(found), "doc_id", "left_anti").select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(docs, key=pii.session_key(spark)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("minhash", drop_near_duplicates), ("pii", replace_personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
