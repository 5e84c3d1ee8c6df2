from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """Counts of what stands between single spaces, empty strings included."""
    return lines.select(F.explode(F.split(text, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
