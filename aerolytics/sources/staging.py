"""Staging: zip archives to lines, lines to a table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in archive.namelist():
                    if name.lower().endswith(".csv"):
                        with archive.open(name) as member:
                            lines = io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="\n")
                            while part := lines.readlines(4 << 20):
                                yield pd.DataFrame({"archive": path, "member": name, "value": [x.rstrip("\r\n") for x in part]})


def unzip_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the CSV members of zip archives, streamed member by member."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "archive string, member string, value string")


def load_raw_lines(lines: DataFrame, table_path: str, mode: str = "overwrite") -> None:
    """The raw line table: one string column, block-compressed."""
    lines.select("value").write.mode(mode).option("compression", "zstd").parquet(table_path)
