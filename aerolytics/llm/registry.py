"""The subpackage's queries: opN_<name>(spark, sf_dir), over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprints, lm, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity
from .common import table

SHARDS = 24


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.ShardTree.of(SHARDS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collapse over a log that holds every conversation once for each of its turns."""
    return chat.collapse(chat.snapshots(table(spark, sf_dir, "conversations")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_lm": op1_lm, "op2_shard": op2_shard, "op3_toxicity": op3_toxicity, "op4_suffix_dedup": op4_suffix_dedup, "op5_mix": op5_mix, "op6_decontaminate": op6_decontaminate, "op7_chat": op7_chat, "op8_ngram_join": op8_ngram_join, "op9_quality": op9_quality, "op10_fingerprint": op10_fingerprint, "chat_snapshots": chat_snapshots}
ORACLE: dict[str, str] = {"op7_chat": chat.ORACLE, "chat_snapshots": chat.SNAPSHOTS_ORACLE}
