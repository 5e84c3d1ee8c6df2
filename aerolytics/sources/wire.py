"""The message format: nine fields joined by single spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_double

ORDER = ("origin", "dest", "flight_date", "carrier", "flight_num", "crs_dep_time", "dep_time", "dep_delay", "arr_delay")


def to_wire(flights: DataFrame) -> DataFrame:
    """One `value` per flight; a missing field becomes an empty one."""
    return flights.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ORDER]).alias("value"))


def _typed(tokens: DataFrame) -> DataFrame:
    field = dict(zip(ORDER, (F.get("t", F.lit(i)) for i in range(9)), strict=True))
    text = [F.when(field[c] != "", field[c]).alias(c) for c in ORDER if c not in ("flight_date", "dep_delay", "arr_delay")]
    return tokens.select(*text, field["flight_date"].try_cast("date").alias("flight_date"), *[parse_double(field[c]).alias(c) for c in ("dep_delay", "arr_delay")])


def flights_from_wire(messages: DataFrame) -> DataFrame:
    """Single spaces separate, so empty fields keep their place."""
    return _typed(messages.select(F.split("value", " ").alias("t")))


def flights_from_wire_compat(messages: DataFrame, least: int = 9) -> DataFrame:
    """Any run of white space separates: empty fields vanish and later ones move left. Keeps messages of `least` fields."""
    tokens = messages.select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("t"))
    return _typed(tokens.filter(F.size("t") >= least))
