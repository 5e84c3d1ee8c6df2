"""Keyed tables as Parquet.

A table is a folder of versions, `v=N`, each a folder of parts. A version counts once its part `base` is whole (has
_SUCCESS), so readers and retries see whole versions only; an append adds a part to the newest version and leaves the
others alone. A streaming batch names its version or part by its batch id: a batch that is delivered again writes
over what it wrote. Versions before the last `keep` are deleted, as a running reader may still hold the one before."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _whole(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions, oldest first."""
    numbers = sorted(int(x[2:]) for x in _folders(spark, path) if x.startswith("v="))
    return [n for n in numbers if _whole(spark, f"{path}/v={n}/part=base")]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or None."""
    have = versions(spark, path)
    if not have:
        return None
    parts = [f"{path}/v={have[-1]}/{x}" for x in _folders(spark, f"{path}/v={have[-1]}") if x.startswith("part=")]
    return spark.read.parquet(*[p for p in parts if _whole(spark, p)])


def overwrite_rows(rows: DataFrame, path: str, batch: int | None = None, keep: int = 2) -> bool:
    """Replaces the table; an empty frame leaves it. Rows that the frame lacks are gone: use upsert_rows for partial results."""
    if rows.isEmpty():
        return False
    spark = rows.sparkSession
    have = versions(spark, path)
    last = (have or [0])[-1]
    new = last + 1 if batch is None or batch + 1 < last else batch + 1  # a batch id that starts anew goes on from what is there
    rows.write.mode("overwrite").parquet(f"{path}/v={new}/part=base")
    older = [n for n in have if n < new]
    for old in older[: max(0, len(older) - (keep - 1))]:
        fs, p = _fs(spark, f"{path}/v={old}")
        fs.delete(p, True)
    return True


def append_rows(rows: DataFrame, path: str, batch: int | None = None) -> bool:
    """Adds rows; what is there is neither read nor written again."""
    if rows.isEmpty():
        return False
    have = versions(rows.sparkSession, path)
    if not have:
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/v=1/part=base")
    name = uuid.uuid4().hex if batch is None else f"batch-{batch}"
    rows.write.mode("overwrite").parquet(f"{path}/v={(have or [1])[-1]}/part={name}")
    return True


def upsert_rows(rows: DataFrame, path: str, keys: Sequence[str], batch: int | None = None) -> bool:
    """The newest row of each key wins; applying the same rows again changes nothing."""
    if rows.isEmpty():
        return False
    old = read_table(rows.sparkSession, path)
    fresh = rows.withColumn("_new", F.lit(1))
    if old is not None:
        fresh = fresh.unionByName(old.withColumn("_new", F.lit(0)))
    order = W.partitionBy(*keys).orderBy(F.desc("_new"), *sorted(set(rows.columns) - set(keys)))
    latest = fresh.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_new")
    if batch is not None and batch + 1 in versions(rows.sparkSession, path):
        batch = None  # delivered before: its own version is read here and must not be written over
    return overwrite_rows(latest, path, batch)
