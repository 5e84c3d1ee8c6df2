"""The best flight of a route, day and half of the day; trips of two legs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import am_or_pm, hhmm_pretty
from .delays import selected_pairs

KEYS = ("origin", "dest", "flight_date", "am_or_pm")


def best_flights(flights: DataFrame, year: int | None = None) -> DataFrame:
    """The flight of least arrival delay for each key; ties go to the smallest (carrier, number, time).

    Runs on streams too: min_by over structs keeps one row of state a key."""
    rows = flights.filter(F.col("arr_delay").isNotNull() & (F.length("origin") == 3) & (F.length("crs_dep_time") >= 4))
    if year is not None:
        first = lambda y: F.lit(f"{y}-01-01").cast("date")
        rows = rows.filter((F.col("flight_date") >= first(year)) & (F.col("flight_date") < first(year + 1)))
    rows = rows.withColumns({"am_or_pm": am_or_pm("crs_dep_time"), "departure_time": hhmm_pretty("crs_dep_time")}).filter(F.col("am_or_pm").isNotNull())
    one = F.struct("arr_delay", "carrier", "flight_num", "departure_time")
    return rows.groupBy(*KEYS).agg(F.min(one).alias("b")).select(*KEYS, "b.carrier", "b.flight_num", "b.departure_time", "b.arr_delay")


def pick_keys(best: DataFrame, keys: Iterable[Sequence]) -> DataFrame:
    return selected_pairs(best, KEYS, keys)


def lookup(best: DataFrame, origin: str, dest: str, date: str, half: str) -> DataFrame:
    """At most one row; empty when there is no such flight."""
    return best.filter((F.col("origin") == origin) & (F.col("dest") == dest) & (F.col("flight_date") == F.lit(date).cast("date")) & (F.col("am_or_pm") == half)).select("carrier", "flight_num", "departure_time", "arr_delay").limit(1)


def two_leg_trips(best: DataFrame, days: int = 2) -> DataFrame:
    """X to Y in the morning, on from Y in the afternoon so many days later: an equi-join of the best flights."""
    legs = ("carrier", "flight_num", "departure_time", "arr_delay")
    first = best.filter(F.col("am_or_pm") == "AM").select(F.col("origin").alias("x"), F.col("dest").alias("y"), F.col("flight_date").alias("first_date"), *[F.col(c).alias(f"first_{c}") for c in legs], F.date_add("flight_date", days).alias("second_date"))
    second = best.filter(F.col("am_or_pm") == "PM").select(F.col("origin").alias("y"), F.col("dest").alias("z"), F.col("flight_date").alias("second_date"), *[F.col(c).alias(f"second_{c}") for c in legs])
    return first.join(second, ["y", "second_date"]).select("x", "y", "z", "first_date", *[f"first_{c}" for c in legs], "second_date", *[f"second_{c}" for c in legs])


def messages_best(best: DataFrame) -> DataFrame:
    return best.select(F.concat_ws(" ", *KEYS, "carrier", "flight_num", "departure_time", F.col("arr_delay").cast("string")).alias("value"))
