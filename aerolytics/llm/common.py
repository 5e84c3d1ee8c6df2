"""What the operators share: column access, scratch tables and words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """df as one struct column, so that columns beside it cannot clash with its own; select(f"{name}.*") undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir or the context's own; for a local master without either, a temporary one."""
    context = spark.sparkContext
    app, own = context.applicationId, context._jsc.sc().getCheckpointDir()
    if shared := spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None):
        return f"{shared.rstrip('/')}/{app}"
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if app not in _local:
        folder = tempfile.TemporaryDirectory(prefix="aerolytics-")
        atexit.register(folder.cleanup)
        _local[app] = folder.name
    return _local[app]


#: Spark then deletes a query's shuffle files once its result is written, and not when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, survives lost executors, frees shuffle files."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        paths = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_of(column: Column) -> Column:
    """crc32 (unsigned) of a value written as text; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def n_words(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
