"""Raw on-time CSV lines. Two modes:

strict  real CSV quoting (default): the header is skipped, short or unreadable rows are dropped and counted.
naive   quotes deleted and a plain split on commas, so that ordinals after a quoted city hold a shift by one;
        kept for results that must agree with files read that way. Header lines pass as data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_double, strip_quotes

FIELDS = ("flight_date", "carrier", "flight_num", "origin", "dest", "crs_dep_time", "dep_time", "dep_delay", "arr_delay")
# Positions of the fields in the published files.
NAIVE = dict(zip(FIELDS, (5, 8, 10, 11, 18, 25, 26, 27, 38), strict=True))
STRICT = dict(zip(FIELDS, (5, 8, 10, 11, 17, 23, 24, 25, 36), strict=True))


def header_ordinals(mode: str = "strict") -> dict[str, int]:
    return dict(NAIVE if mode == "naive" else STRICT)


def _typed(tokens: DataFrame, at: dict[str, int]) -> DataFrame:
    field = {k: F.get("tokens", F.lit(i)) for k, i in at.items()}
    text = [F.when(field[k] != "", field[k]).alias(k) for k in ("carrier", "flight_num", "origin", "dest", "crs_dep_time", "dep_time")]
    return tokens.select(
        *text,
        field["flight_date"].try_cast("date").alias("flight_date"),
        *[parse_double(field[k]).alias(k) for k in ("dep_delay", "arr_delay")],
        # a delay that is present but no number
        F.expr(" + ".join(f"int(coalesce({k}_raw <> '' and {k}_num is null, false))" for k in ("dep", "arr"))).alias("bad_delays"),
    )


def _flagged(lines: DataFrame, mode: str) -> DataFrame:
    """All lines as flights, with `kept`: whether the mode takes them."""
    at = header_ordinals(mode)
    if mode == "naive":
        tokens = lines.select(F.split(strip_quotes("value"), ",").alias("tokens"))
    else:
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(at.values()) + 1)])
        parsed = lines.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"}).alias("r"))
        tokens = parsed.select(F.array(*[F.col(f"r.{f.name}") for f in schema]).alias("tokens"))
    raw = {k: F.get("tokens", F.lit(at[f"{k}_delay"])) for k in ("dep", "arr")}
    tokens = tokens.withColumns({f"{k}_raw": v for k, v in raw.items()} | {f"{k}_num": parse_double(v) for k, v in raw.items()})
    codes = (F.length("origin") == 3) & (F.length("dest") == 3) & F.col("flight_date").isNotNull()
    return _typed(tokens, at).withColumn("kept", F.col("origin").isNotNull() if mode == "naive" else F.coalesce(codes, F.lit(False)))


def flights_from_lines(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Typed flights (with bad_delays, the count of unreadable delays of the row) from a `value` column of lines.

    strict keeps rows with a date and three-character codes at both ends; naive keeps whatever has an origin."""
    return _flagged(lines, mode).filter("kept").drop("kept")


def wide_lines(lines: DataFrame, more_than: int = NAIVE["arr_delay"]) -> DataFrame:
    """Lines of more than so many fields by the plain comma split, quotes deleted: what reaches the last field read."""
    return lines.filter(F.size(F.split(strip_quotes("value"), ",")) > more_than)


def read_flights(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """path may be a glob, which is how a year is picked out."""
    return flights_from_lines(spark.read.text(path), mode)


def read_flights_strict(spark: SparkSession, path: str) -> DataFrame:
    return read_flights(spark, path, "strict")


def bad_rows(lines: DataFrame) -> DataFrame:
    """One row, in one pass: lines, kept rows, dropped rows (headers included) and unreadable delays of kept rows."""
    sums = _flagged(lines, "strict").agg(F.count("*").alias("lines"), F.count_if("kept").alias("kept"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bad_delays"))), F.lit(0)).alias("bad_delays"))
    return sums.select("lines", "kept", (F.col("lines") - F.col("kept")).alias("dropped"), "bad_delays")
