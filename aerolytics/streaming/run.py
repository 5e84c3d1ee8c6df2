"""The same transforms over a stream of lineitem files, run until the input is used up.

A running aggregate in complete mode holds one row a key (airports, routes, carriers), without expiry, as the
questions ask for totals since the start. Rankings per key, which a stream cannot hold, are made of each complete
result in foreachBatch. The newest result lies in a keyed table whose versions are written whole and named by batch id, so
that a batch which is delivered again changes nothing. With a `base` folder of its own, a twin that is started again
goes on from its checkpoint: it reads only the files that it has not seen, and keeps its state.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import best_flights, endpoint_counts, mean_delay, smallest, smallest_per, top, word_counts
from ..plans import flights_by_region, flights_over
from ..sinks import overwrite_rows, read_table
from ..sources import Tables


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for checkpoints and results: in spark.checkpoint.dir, which all executors share; a local one only for a local master."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def lineitem_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """lineitem.parquet, a file or a folder of files, as a stream; at most so many files a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/lineitem.parquet*")


#: name: (running aggregate over the flights of lineitem rows, what is made of each complete result)
TWINS: dict[str, tuple[Callable[[Tables, DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "q11": (lambda t, rows: endpoint_counts(flights_over(t, rows)), lambda d: top(d, "n", "airport")),
    "q12": (lambda t, rows: mean_delay(flights_over(t, rows), ["carrier"], "arr_delay"), lambda d: smallest(d, "avg_delay", ["carrier"])),
    "q21": (lambda t, rows: mean_delay(flights_over(t, rows), ["origin", "carrier"], "dep_delay"), lambda d: smallest_per(d, "origin", "avg_delay", "carrier")),
    "q22": (lambda t, rows: mean_delay(flights_over(t, rows), ["origin", "dest"], "dep_delay"), lambda d: smallest_per(d, "origin", "avg_delay", "dest")),
    "q24": (lambda t, rows: mean_delay(flights_over(t, rows), ["origin", "dest"], "arr_delay"), lambda d: d),
    "q32": (lambda t, rows: best_flights(flights_by_region(t, rows)), lambda d: d),
}


def run_twin(spark: SparkSession, sf_dir: str, name: str, every: str | None = None, sinks: tuple[Callable[[DataFrame], None], ...] = (), base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Runs one twin over what is there (or, with `every`, say "3 seconds", for ever) and returns its newest result.

    base: the folder of its checkpoint and results, kept for the next start; without one, a scratch folder."""
    tables = Tables(spark, sf_dir)
    aggregate, finish = TWINS[name]
    base = base or scratch(spark, f"stream-{name}")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        result = finish(batch)
        overwrite_rows(result, f"{base}/table", batch_id)  # empty batches leave it alone
        for sink in sinks:
            sink(result)

    running = aggregate(tables, lineitem_stream(spark, sf_dir, files_per_batch))
    writer = running.writeStream.outputMode("complete").foreachBatch(deliver).option("checkpointLocation", f"{base}/checkpoint")
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    query.awaitTermination()
    result = read_table(spark, f"{base}/table")
    return result if result is not None else finish(aggregate(tables, tables.lineitem.limit(0)))


def batch_word_counts(lines: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str):
    """Word counts of each micro-batch alone: nothing is carried over."""
    return lines.writeStream.foreachBatch(lambda batch, _: sink(word_counts(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
