"""One SQL text, read alike by Spark and by the oracle, that gives the star schema the shape of flights.

lineitem is the fact; the other tables are joined on their keys and Catalyst picks broadcast or shuffle from
their measured sizes. Delays are whole numbers, so that sums and averages agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

FLIGHTS_SQL = """
SELECT concat('N', lpad(CAST(s_nationkey AS VARCHAR(4)), 2, '0')) AS origin,
       concat('N', lpad(CAST(c_nationkey AS VARCHAR(4)), 2, '0')) AS dest,
       CAST(l_shipdate AS DATE) AS flight_date,
       p_brand AS carrier,
       CAST(l_orderkey AS VARCHAR(20)) AS flight_num,
       concat(lpad(CAST((l_orderkey * 7 + l_linenumber * 5) % 24 AS VARCHAR(4)), 2, '0'), lpad(CAST(l_partkey % 60 AS VARCHAR(4)), 2, '0')) AS crs_dep_time,
       CASE WHEN l_discount < 0.095 THEN CAST(CAST(l_quantity AS INT) - 20 AS DOUBLE) END AS dep_delay,
       CASE WHEN l_tax < 0.075 THEN CAST(CAST(l_quantity AS INT) - 20 + CAST(l_partkey % 31 AS INT) - 15 AS DOUBLE) END AS arr_delay,
       s_nationkey AS origin_key, c_nationkey AS dest_key
FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
"""

#: Coarser keys, so that groups of the best-flight question hold several flights: region codes, and the first of the month or the day.
REGION_MONTH_SQL = """
SELECT concat('R', lpad(CAST(a.n_regionkey AS VARCHAR(4)), 2, '0')) AS origin,
       concat('R', lpad(CAST(b.n_regionkey AS VARCHAR(4)), 2, '0')) AS dest,
       {date} AS flight_date, carrier, flight_num, crs_dep_time, dep_delay, arr_delay
FROM flights JOIN nation a ON origin_key = a.n_nationkey JOIN nation b ON dest_key = b.n_nationkey
"""

_FACT = ("lineitem", "supplier", "orders", "customer", "part")


def flights_over(tables: Tables, lineitem: DataFrame | None = None, **other: DataFrame) -> DataFrame:
    """The view; lineitem may be a stream, and any other table another frame of its columns."""
    frames = {k: getattr(tables, k) for k in _FACT} | other
    if lineitem is not None:
        frames["lineitem"] = lineitem
    sql = FLIGHTS_SQL
    for k in _FACT:
        sql = sql.replace(f"JOIN {k} ", f"JOIN {{{k}}} ").replace(f"FROM {k}\n", f"FROM {{{k}}}\n")
    return tables.spark.sql(sql, **frames)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights_over(Tables(spark, sf_dir))


def flights_by_region(tables: Tables, lineitem: DataFrame | None = None, month: bool = True) -> DataFrame:
    """The view with regions for airports and, with `month`, the first of the month for the day.

    Regions take the place of nations in supplier and customer, so that no more joins meet the fact."""
    nation = tables.nation.select("n_nationkey", F.col("n_regionkey").alias("region"))

    def coarse(frame: DataFrame, key: str) -> DataFrame:
        return frame.join(nation, F.col(key) == F.col("n_nationkey")).withColumn(key, F.col("region")).drop("region", "n_nationkey")

    base = flights_over(tables, lineitem, supplier=coarse(tables.supplier, "s_nationkey"), customer=coarse(tables.customer, "c_nationkey"))
    code = lambda c: F.concat(F.lit("R"), F.substring(c, 2, 2)).alias(c)
    date = F.trunc("flight_date", "MM") if month else F.col("flight_date")
    return base.select(code("origin"), code("dest"), date.alias("flight_date"), "carrier", "flight_num", "crs_dep_time", "dep_delay", "arr_delay")


def lineitem_of_year(tables: Tables, year: int) -> DataFrame:
    """lineitem of a year by a range of its raw date, which reaches the scan."""
    first = lambda y: F.lit(f"{y}-01-01").cast(tables.lineitem.schema["l_shipdate"].dataType)
    return tables.lineitem.filter((F.col("l_shipdate") >= first(year)) & (F.col("l_shipdate") < first(year + 1)))
