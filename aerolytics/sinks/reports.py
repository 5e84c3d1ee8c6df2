"""Text sinks. Reports are formatted by Spark and streamed to one file over the old one; empty frames leave it alone.
Key-value lines are written by the executors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The lines of the reports.
SECTION = "--- {} ---"
NAMED = "(%s: %s)"
ROUTE = "%s -> %s: %s"
BEST = "%s -> %s on %s: Flight: %s %s at %s. Arrival Delay: %s"


def _write(path: str, lines: Iterable[str]) -> bool:
    lines = iter(lines)
    first = next(lines, None)
    if first is None:
        return False
    with Path(path).open("w") as out:
        out.writelines(f"{x}\n" for x in chain([first], lines))
    return True


def _each(lines: DataFrame) -> Iterable[str]:
    """The lines in order, a partition at a time."""
    return (r[0] for r in lines.toLocalIterator())


def report_flat(ranked: DataFrame, name: str, value: str, path: str, k: int = 10) -> bool:
    """`name  value`, k lines at most, in the frame's order."""
    return _write(path, [r[0] for r in ranked.limit(k).select(F.concat_ws("  ", F.col(name).cast("string"), F.col(value).cast("string"))).collect()])


def report_sections(ranked: DataFrame, key: str, name: str, value: str, path: str, keys: list[str], k: int = 10) -> bool:
    """A section with `(name: value)` lines for each of the keys asked for; ranked holds a `rank`."""
    rows = ranked.filter(F.col(key).isin(*keys) & (F.col("rank") <= k)).select(F.col(key).alias("k"), "rank", F.format_string(NAMED, F.col(name), F.col(value).cast("string")).alias("line")).collect()
    lines = []
    for one in keys:
        if part := sorted((r["rank"], r["line"]) for r in rows if r["k"] == one):
            lines += [SECTION.format(one), *(x for _, x in part)]
    return _write(path, lines)


def report_routes(means: DataFrame, value: str, path: str) -> bool:
    """A line for every route, by route."""
    return _write(path, _each(means.orderBy("origin", "dest").select(F.format_string(ROUTE, "origin", "dest", F.col(value).cast("string")))))


def report_best(best: DataFrame, path: str) -> bool:
    """A line for every best flight, by key."""
    line = F.format_string(BEST, "origin", "dest", F.col("flight_date").cast("string"), "carrier", "flight_num", "departure_time", F.col("arr_delay").cast("string"))
    return _write(path, _each(best.orderBy("origin", "dest", "flight_date", "am_or_pm").select(line)))


def key_value_lines(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One `value` for each row: the keys joined by spaces, a tab, the value."""
    return frame.select(F.concat(F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]), F.lit("\t"), F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("value"))


def write_key_value(frame: DataFrame, keys: Sequence[str], value: str, path: str) -> None:
    """Key-value lines as text files, one for each partition of the frame."""
    key_value_lines(frame, keys, value).write.mode("overwrite").text(path)


def console_sample(frame: DataFrame, k: int = 10) -> int:
    """Shows k rows, returns the count."""
    frame.show(k, truncate=False)
    return frame.count()


def console_stream(frame: DataFrame, checkpoint: str, k: int = 10, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Prints the first k rows of every micro-batch; once: until the input that is there is used up."""
    writer = frame.writeStream.format("console").option("numRows", k).option("truncate", False).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()
