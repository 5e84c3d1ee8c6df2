"""Rankings with a total order: value first, then name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(counts: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    """The k largest (TakeOrderedAndProject: a top-k of each partition first)."""
    return counts.orderBy(F.desc(value), name).limit(k)


def smallest(means: DataFrame, value: str, names: Sequence[str], k: int = 10) -> DataFrame:
    return means.orderBy(value, *names).limit(k)


def smallest_per(means: DataFrame, key: str, value: str, name: str, k: int = 10) -> DataFrame:
    """The k smallest of each key with their rank; no padding. Spark cuts each partition to k a key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(value, name))
    return means.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_list_per(means: DataFrame, key: str, value: str, name: str, k: int = 10) -> DataFrame:
    """As smallest_per, as one array of (value, name) for each key; at most k elements are ever collected."""
    cut = smallest_per(means, key, value, name, k)
    return cut.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name, value))), lambda x: F.struct(x[name], x[value])).alias("best"))


def rank_all(counts: DataFrame, value: str, name: str) -> DataFrame:
    return counts.orderBy(F.desc(value), name)


def first_per_count(counts: DataFrame, value: str, name: str) -> DataFrame:
    """One name for each distinct count (the smallest), largest count first: ties are lost."""
    return counts.groupBy(value).agg(F.min(name).alias(name)).orderBy(F.desc(value))


def first_token_counts(lines: DataFrame) -> DataFrame:
    """(name, count) from `value` lines: the first and the last token; lines with an unreadable count are skipped."""
    tokens = F.split("value", r"\s")
    out = lines.select(F.element_at(tokens, 1).alias("airport"), F.element_at(tokens, -1).try_cast("bigint").alias("n"))
    return out.filter(F.col("n").isNotNull())
