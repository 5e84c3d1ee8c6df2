"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity          documents that score 0.5 or more go
ngram_join        one document of each group of near-duplicates stays (five-word shingles, Jaccard 0.8 or more)
decontamination   documents that hold a benchmark item go
mixing            sources are mixed to target weights: a document stays, goes or repeats whole
sharding          every row gets its shard, a column that the last stage adds
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from aerolytics.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from aerolytics.llm.common import scratch_root, table

SHARDS = 24


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, ngram_join.Join(k=5, num=80, den=100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_copies(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs, sharding.ShardTree.of(SHARDS))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learnt scores, similarity components and seeded choices have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
