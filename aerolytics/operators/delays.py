"""Counts and means by key. Everything here also runs on streams."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cents_half_up


def endpoint_counts(flights: DataFrame) -> DataFrame:
    """Flights from or to each airport; a flight with equal ends counts twice.

    Routes are counted first, so that counts and not flights are doubled; a stream, which holds one aggregate, doubles flights."""
    ends = F.explode(F.array("origin", "dest")).alias("airport")
    if flights.isStreaming:
        return flights.select(ends).groupBy("airport").agg(F.count("*").alias("n"))
    routes = flights.groupBy("origin", "dest").agg(F.count("*").alias("k"))
    return routes.select(ends, "k").groupBy("airport").agg(F.sum("k").alias("n"))


def mean_delay(flights: DataFrame, keys: Sequence[str], delay: str, name: str = "avg_delay") -> DataFrame:
    """Mean of the delays that are there; keys without any give no row."""
    return flights.filter(F.col(delay).isNotNull()).groupBy(*keys).agg(F.avg(delay).alias(name), F.count("*").alias("n"))


def mean_delay_cents(flights: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """The mean in hundredths, rounded half up, for rankings that see two decimals only."""
    sums = flights.filter(F.col(delay).isNotNull()).groupBy(*keys).agg(F.sum(delay).alias("s"), F.count("*").alias("n"))
    return sums.select(*keys, cents_half_up(F.col("s"), F.col("n")).alias("avg_cents"), "n")


def selected(frame: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return frame.filter(F.col(column).isin(*values))


def selected_pairs(frame: DataFrame, columns: Sequence[str], tuples: Iterable[Sequence]) -> DataFrame:
    """Rows whose columns equal one of the tuples."""
    test = F.lit(False)
    for t in tuples:
        one = F.lit(True)
        for c, v in zip(columns, t, strict=True):
            one = one & (F.col(c) == F.lit(v))
        test = test | one
    return frame.filter(test)


def coded(frame: DataFrame, *columns: str, length: int = 3) -> DataFrame:
    """Rows whose columns are all codes of that length, as the serving tables take them."""
    for c in columns:
        frame = frame.filter(F.length(c) == length)
    return frame
