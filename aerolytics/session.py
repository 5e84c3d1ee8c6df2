from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session: UTC, few shuffle partitions; a cluster passes its own through spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("aerolytics")
    for k, v in {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
