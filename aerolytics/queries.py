"""The registered queries of the flight questions, and the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .plans import FLIGHTS_SQL, REGION_MONTH_SQL, flights, flights_by_region, lineitem_of_year
from .sources import Tables, flights_from_lines, flights_from_wire, header_ordinals, to_wire, wide_lines
from .sinks import key_value_lines, route_messages, top_messages
from .streaming import run_twin

AIRPORTS = ("N00", "N05", "N10", "N15", "N20")
ROUTES = (("N00", "N01"), ("N05", "N05"), ("N10", "N20"), ("N24", "N03"))
BEST_KEYS = tuple((f"R0{a}", f"R0{b}", f"199{y}-0{m}-01", h) for a, b, y, m, h in ((0, 1, 6, 1, "AM"), (1, 2, 6, 3, "PM"), (2, 3, 7, 5, "AM"), (3, 4, 7, 7, "PM"), (4, 0, 8, 2, "AM"), (0, 2, 8, 4, "PM"), (1, 3, 5, 6, "AM"), (2, 2, 5, 8, "PM")))
XMIN = 10
#: A power law and a lognormal to compare over the counts of airports (xmin, alpha, mu, sigma).
LAWS = (10.0, 1.5, 8.0, 1.5)

Query = Callable[[SparkSession, str], DataFrame]


def _best(s: SparkSession, d: str, month: bool = True, year: int | None = None) -> DataFrame:
    t = Tables(s, d)
    return op.best_flights(flights_by_region(t, None if year is None else lineitem_of_year(t, year), month), year)


def _daily_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("origin", "flight_date").agg(F.count("*").alias("n"))


def _route_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("origin", "dest").agg(F.count("*").alias("n"))


def _avg(keys: list[str], delay: str) -> Query:
    return lambda s, d: op.mean_delay(flights(s, d), keys, delay)


def _top_per(name: str) -> Query:
    return lambda s, d: op.smallest_per(op.mean_delay(flights(s, d), ["origin", name], "dep_delay"), "origin", "avg_delay", name)


def _fit(s: SparkSession, d: str) -> DataFrame:
    got = op.likelihood_ratio(_route_counts(flights(s, d)), "n")
    return s.createDataFrame([{k: float(v) for k, v in got.items()}])


def _raw_lines(f: DataFrame) -> DataFrame:
    """Flights as raw CSV lines: cities are quoted and hold a comma, other unread fields are empty."""
    at = {v: k for k, v in header_ordinals().items()}
    city = F.lit('"City, ST"')
    value = {"dep_time": F.col("crs_dep_time")}
    cells = [F.coalesce(value.get(at[i], F.col(at[i])).cast("string"), F.lit("")) if i in at else city if i in (12, 18) else F.lit("") for i in range(40)]
    return f.select(F.concat_ws(",", *cells).alias("value"))


def _read_back(mode: str) -> Query:
    keep = ("origin", "dest", "flight_date", "carrier", "flight_num", "crs_dep_time", "dep_time", "dep_delay", "arr_delay")
    return lambda s, d: flights_from_lines(_raw_lines(flights(s, d)), mode).select(*keep)


def _union_of_keys(s: SparkSession, d: str) -> DataFrame:
    best = _best(s, d)
    return reduce(DataFrame.unionByName, [op.pick_keys(best, [k]) for k in BEST_KEYS])


def _ranked_text(s: SparkSession, d: str) -> DataFrame:
    lines = op.endpoint_counts(flights(s, d)).select(F.concat_ws("\t", "airport", F.col("n").cast("string")).alias("value"))
    return op.first_per_count(op.first_token_counts(lines), "n", "airport")


QUERIES: dict[str, Query] = {
    "io1_flights_view": lambda s, d: flights(s, d).drop("origin_key", "dest_key"),
    "q11_airport_counts": lambda s, d: op.endpoint_counts(flights(s, d)),
    "q11_top10_airports": lambda s, d: op.top(op.endpoint_counts(flights(s, d)), "n", "airport"),
    "q11_rank_tie_drop": lambda s, d: op.first_per_count(op.endpoint_counts(flights(s, d)), "n", "airport"),
    "q11_rank_all": lambda s, d: op.rank_all(op.endpoint_counts(flights(s, d)), "n", "airport"),
    "q12_carrier_avg": _avg(["carrier"], "arr_delay"),
    "q12_top10_carriers": lambda s, d: op.smallest(op.mean_delay(flights(s, d), ["carrier"], "arr_delay"), "avg_delay", ["carrier"]),
    "q12_top10_rounded": lambda s, d: op.smallest(op.mean_delay_cents(flights(s, d), ["carrier"], "arr_delay"), "avg_cents", ["carrier"]),
    "q21_avg": _avg(["origin", "carrier"], "dep_delay"),
    "q21_top10": _top_per("carrier"),
    "q21_selected_airports": lambda s, d: op.selected(_top_per("carrier")(s, d), "origin", AIRPORTS),
    "q21_one_airport": lambda s, d: op.smallest(op.selected(op.mean_delay(flights(s, d), ["origin", "carrier"], "dep_delay"), "origin", AIRPORTS[:1]), "avg_delay", ["carrier"]),
    "q21_serving_top3": lambda s, d: op.smallest(op.selected(op.mean_delay(flights(s, d), ["origin", "carrier"], "dep_delay"), "origin", AIRPORTS[1:2]), "avg_delay", ["carrier"], 3),
    "q21_messages": lambda s, d: top_messages(op.top_list_per(op.mean_delay_cents(flights(s, d), ["origin", "carrier"], "dep_delay"), "origin", "avg_cents", "carrier"), "origin"),
    "q22_avg": _avg(["origin", "dest"], "dep_delay"),
    "q22_top10": _top_per("dest"),
    "q22_rounded_top10": lambda s, d: op.smallest_per(op.mean_delay_cents(flights(s, d), ["origin", "dest"], "dep_delay"), "origin", "avg_cents", "dest"),
    "q24_mean_arrival": _avg(["origin", "dest"], "arr_delay"),
    "q24_selected_routes": lambda s, d: op.selected_pairs(op.mean_delay(flights(s, d), ["origin", "dest"], "arr_delay"), ("origin", "dest"), ROUTES),
    "q24_route_messages": lambda s, d: route_messages(op.mean_delay_cents(flights(s, d), ["origin", "dest"], "arr_delay"), ("origin", "dest", "avg_cents")),
    "q31_ccdf": lambda s, d: op.ccdf(_daily_counts(flights(s, d)), "n"),
    "q31_alpha_fixed_xmin": lambda s, d: op.power_law_alpha(op.endpoint_counts(flights(s, d)), "n", XMIN).select("n_tail", F.col("alpha").cast("decimal(18,6)").alias("alpha")),
    "q31_power_law": lambda s, d: op.best_power_law(_route_counts(flights(s, d)), "n").select("xmin", "n_tail", *[F.col(c).cast("decimal(18,6)").alias(c) for c in ("alpha", "D")]),
    "q31_scan": lambda s, d: op.power_law_scan(_route_counts(flights(s, d)), "n").select("xmin", "n_tail", *[F.col(c).cast("decimal(18,6)").alias(c) for c in ("alpha", "D")]),
    "q31_lognormal": lambda s, d: op.lognormal_whole(_route_counts(flights(s, d)), "n").select("n", *[F.col(c).cast("decimal(18,6)").alias(c) for c in ("mu", "sigma")]),
    "q31_ratio": lambda s, d: op.ratio(_route_counts(flights(s, d)), "n", *LAWS).select("n", F.col("R").cast("decimal(18,6)").alias("R")),
    "q31_fits": _fit,
    "q32_best_flights": _best,
    "q32_year": lambda s, d: _best(s, d, False, 1998),
    "q32_selected_keys": lambda s, d: op.pick_keys(_best(s, d), BEST_KEYS),
    "q32_lookup": lambda s, d: op.lookup(_best(s, d), *BEST_KEYS[0]),
    "q32_two_leg_trip": lambda s, d: op.two_leg_trips(_best(s, d, False)),
    "p4_wire_round_trip": lambda s, d: flights_from_wire(to_wire(flights(s, d).withColumn("dep_time", F.col("crs_dep_time")))).select("origin", "dest", "flight_date", "carrier", "flight_num", "crs_dep_time", "dep_time", "dep_delay", "arr_delay"),
    "p1_naive_csv": _read_back("naive"),
    "p1_strict_csv": _read_back("strict"),
    "f2_wide_lines": lambda s, d: wide_lines(_raw_lines(flights(s, d)).unionAll(_raw_lines(flights(s, d)).select(F.substring_index("value", ",", 20)))).agg(F.count("*").alias("n")),
    "f5_coded_routes": lambda s, d: op.coded(op.mean_delay(flights(s, d).withColumn("dest", F.when(F.col("dest") == "N03", "N03X").otherwise(F.col("dest"))), ["origin", "dest"], "arr_delay"), "origin", "dest"),
    "io7_key_value": lambda s, d: key_value_lines(op.mean_delay_cents(flights(s, d), ["origin", "dest"], "arr_delay"), ["origin", "dest"], "avg_cents"),
    "p12_ranked_text": _ranked_text,
    "u1_union_of_keys": _union_of_keys,
    "a9_top_lists": lambda s, d: op.top_list_per(op.mean_delay_cents(flights(s, d), ["origin", "dest"], "dep_delay"), "origin", "avg_cents", "dest", 3).select("origin", F.concat_ws(" ", F.transform("best", lambda b: F.concat(b["dest"], F.lit(":"), b["avg_cents"].cast("string")))).alias("best")),
    "a10_count": lambda s, d: flights(s, d).agg(F.count("*").alias("n")),
    "wordcount_documents": lambda s, d: op.word_counts(Tables(s, d).documents, "text"),
    **{f"stream_{k}": (lambda s, d, k=k: run_twin(s, d, k)) for k in ("q11", "q12", "q21", "q22", "q24", "q32")},
}

_F = f"WITH flights AS ({FLIGHTS_SQL})"
_REGION = REGION_MONTH_SQL.format(date="CAST(date_trunc('month', flight_date) AS DATE)")
_DAY = REGION_MONTH_SQL.format(date="flight_date")
_COUNTS = "counts AS (SELECT airport, count(*) AS n FROM (SELECT origin AS airport FROM flights UNION ALL SELECT dest FROM flights) GROUP BY airport)"
_CENTS = "CAST(sign(s) * floor((200 * abs(s) + n) / (2 * n)) AS BIGINT)"


def _mean(keys: str, delay: str, name: str = "m") -> str:
    return f"{name} AS (SELECT {keys}, avg({delay}) AS avg_delay, count(*) AS n FROM flights WHERE {delay} IS NOT NULL GROUP BY {keys})"


def _cents(keys: str, delay: str) -> str:
    return f"m AS (SELECT {keys}, {_CENTS} AS avg_cents, n FROM (SELECT {keys}, sum({delay}) AS s, count(*) AS n FROM flights WHERE {delay} IS NOT NULL GROUP BY {keys}))"


def _ranked(key: str, value: str, name: str) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {value}, {name}) AS INT) AS rank FROM m) WHERE rank <= 10"


def _best_sql(view: str) -> str:
    return f"""{_F}, shaped AS ({view}),
halves AS (SELECT *, CASE WHEN CAST(substring(crs_dep_time, 1, 2) AS INT) < 12 THEN 'AM' ELSE 'PM' END AS am_or_pm,
                  concat(substring(crs_dep_time, 1, 2), ':', substring(crs_dep_time, 3, 2)) AS departure_time FROM shaped WHERE arr_delay IS NOT NULL),
best AS (SELECT origin, dest, flight_date, am_or_pm, carrier, flight_num, departure_time, arr_delay FROM
         (SELECT *, row_number() OVER (PARTITION BY origin, dest, flight_date, am_or_pm ORDER BY arr_delay, carrier, flight_num, departure_time) AS r FROM halves) WHERE r = 1)
"""


_DAILY = "daily AS (SELECT origin, flight_date, count(*) AS n FROM flights GROUP BY origin, flight_date)"
_ROUTES = "routes AS (SELECT origin, dest, count(*) AS n FROM flights GROUP BY origin, dest)"
#: Every candidate xmin with the largest distance of its fit from the tail, element by element.
_SCAN = f"""{_F}, {_ROUTES},
c AS (SELECT CAST(a.n AS DOUBLE) AS xmin, count(*) AS n_tail, 1 + count(*) / sum(ln(b.n) - ln(a.n)) AS alpha FROM (SELECT DISTINCT n FROM routes) a JOIN routes b ON b.n >= a.n WHERE a.n < (SELECT max(n) FROM routes) GROUP BY a.n),
e AS (SELECT xmin, n_tail, alpha, n, row_number() OVER (PARTITION BY xmin ORDER BY n) - 1 AS i FROM c JOIN routes ON n >= xmin),
scan AS (SELECT xmin, n_tail, alpha, max(abs(i / n_tail - (1 - pow(n / xmin, 1 - alpha)))) AS D FROM e GROUP BY xmin, n_tail, alpha)"""
_LOG_SF = op.log_sf((math.log(LAWS[0]) - LAWS[2]) / LAWS[3])
_KEYS = " OR ".join(f"(origin = '{a}' AND dest = '{b}' AND flight_date = DATE '{c}' AND am_or_pm = '{h}')" for a, b, c, h in BEST_KEYS)
_LIST = ", ".join(f"'{a}'" for a in AIRPORTS)

ORACLE: dict[str, str] = {
    "io1_flights_view": f"{_F} SELECT origin, dest, flight_date, carrier, flight_num, crs_dep_time, dep_delay, arr_delay FROM flights",
    "q11_airport_counts": f"{_F}, {_COUNTS} SELECT airport, n FROM counts",
    "q11_top10_airports": f"{_F}, {_COUNTS} SELECT airport, n FROM counts ORDER BY n DESC, airport LIMIT 10",
    "q11_rank_tie_drop": f"{_F}, {_COUNTS} SELECT n, min(airport) AS airport FROM counts GROUP BY n ORDER BY n DESC",
    "q11_rank_all": f"{_F}, {_COUNTS} SELECT airport, n FROM counts ORDER BY n DESC, airport",
    "q12_carrier_avg": f"{_F}, {_mean('carrier', 'arr_delay')} SELECT * FROM m",
    "q12_top10_carriers": f"{_F}, {_mean('carrier', 'arr_delay')} SELECT * FROM m ORDER BY avg_delay, carrier LIMIT 10",
    "q12_top10_rounded": f"{_F}, {_cents('carrier', 'arr_delay')} SELECT * FROM m ORDER BY avg_cents, carrier LIMIT 10",
    "q21_avg": f"{_F}, {_mean('origin, carrier', 'dep_delay')} SELECT * FROM m",
    "q21_top10": f"{_F}, {_mean('origin, carrier', 'dep_delay')} {_ranked('origin', 'avg_delay', 'carrier')}",
    "q21_selected_airports": f"{_F}, {_mean('origin, carrier', 'dep_delay')} {_ranked('origin', 'avg_delay', 'carrier')} AND origin IN ({_LIST})",
    "q21_one_airport": f"{_F}, {_mean('origin, carrier', 'dep_delay')} SELECT * FROM m WHERE origin = '{AIRPORTS[0]}' ORDER BY avg_delay, carrier LIMIT 10",
    "q21_serving_top3": f"{_F}, {_mean('origin, carrier', 'dep_delay')} SELECT * FROM m WHERE origin = '{AIRPORTS[1]}' ORDER BY avg_delay, carrier LIMIT 3",
    "q21_messages": f"{_F}, {_cents('origin, carrier', 'dep_delay')}, r AS ({_ranked('origin', 'avg_cents', 'carrier')}) SELECT concat(origin, ' ', carrier, ' ', CAST(avg_cents AS VARCHAR)) AS value FROM r",
    "q22_avg": f"{_F}, {_mean('origin, dest', 'dep_delay')} SELECT * FROM m",
    "q22_top10": f"{_F}, {_mean('origin, dest', 'dep_delay')} {_ranked('origin', 'avg_delay', 'dest')}",
    "q22_rounded_top10": f"{_F}, {_cents('origin, dest', 'dep_delay')} {_ranked('origin', 'avg_cents', 'dest')}",
    "q24_mean_arrival": f"{_F}, {_mean('origin, dest', 'arr_delay')} SELECT * FROM m",
    "q24_selected_routes": f"{_F}, {_mean('origin, dest', 'arr_delay')} SELECT * FROM m WHERE " + " OR ".join(f"(origin = '{a}' AND dest = '{b}')" for a, b in ROUTES),
    "q24_route_messages": f"{_F}, {_cents('origin, dest', 'arr_delay')} SELECT concat(origin, ' ', dest, ' ', CAST(avg_cents AS VARCHAR)) AS value FROM m",
    "q31_ccdf": f"{_F}, {_DAILY} SELECT n, CAST(sum(k) OVER (ORDER BY n DESC) AS BIGINT) AS n_at_least, CAST(sum(k) OVER () AS BIGINT) AS n_all FROM (SELECT n, count(*) AS k FROM daily GROUP BY n)",
    "q31_alpha_fixed_xmin": f"{_F}, {_COUNTS} SELECT count(*) AS n_tail, CAST(1 + count(*) / sum(ln(n / {XMIN}.0)) AS DECIMAL(18,6)) AS alpha FROM counts WHERE n >= {XMIN}",
    "q31_power_law": f"{_SCAN} SELECT xmin, n_tail, CAST(alpha AS DECIMAL(18,6)) AS alpha, CAST(D AS DECIMAL(18,6)) AS D FROM scan ORDER BY round(scan.D, 9), xmin LIMIT 1",
    "q31_scan": f"{_SCAN} SELECT xmin, n_tail, CAST(alpha AS DECIMAL(18,6)) AS alpha, CAST(D AS DECIMAL(18,6)) AS D FROM scan",
    "q31_lognormal": f"{_F}, {_ROUTES} SELECT count(*) AS n, CAST(avg(ln(n)) AS DECIMAL(18,6)) AS mu, CAST(stddev_pop(ln(n)) AS DECIMAL(18,6)) AS sigma FROM routes",
    "q31_ratio": f"{_F}, {_ROUTES}, g AS (SELECT ln(({LAWS[1]} - 1) / {LAWS[0]}) - {LAWS[1]} * ln(n / {LAWS[0]}) + ln(n) + ln({LAWS[3]} * sqrt(2 * pi())) + ((ln(n) - {LAWS[2]}) / {LAWS[3]}) ** 2 / 2 + ({_LOG_SF!r}) AS g FROM routes WHERE n >= {LAWS[0]}) SELECT count(*) AS n, CAST(sum(g) / (stddev_pop(g) * sqrt(count(*))) AS DECIMAL(18,6)) AS R FROM g",
    "f2_wide_lines": f"{_F} SELECT count(*) AS n FROM flights",
    "f5_coded_routes": f"{_F}, {_mean('origin, dest', 'arr_delay')} SELECT * FROM m WHERE dest <> 'N03'",
    "io7_key_value": f"{_F}, {_cents('origin, dest', 'arr_delay')} SELECT concat(origin, ' ', dest, chr(9), CAST(avg_cents AS VARCHAR)) AS value FROM m",
    "q32_best_flights": f"{_best_sql(_REGION)} SELECT * FROM best",
    "q32_year": f"{_best_sql(_DAY)} SELECT * FROM best WHERE year(flight_date) = 1998",
    "q32_selected_keys": f"{_best_sql(_REGION)} SELECT * FROM best WHERE {_KEYS}",
    "q32_lookup": f"{_best_sql(_REGION)} SELECT carrier, flight_num, departure_time, arr_delay FROM best WHERE {_KEYS.split(' OR ')[0]}",
    "q32_two_leg_trip": f"""{_best_sql(_DAY)} SELECT a.origin AS x, a.dest AS y, b.dest AS z, a.flight_date AS first_date,
 a.carrier AS first_carrier, a.flight_num AS first_flight_num, a.departure_time AS first_departure_time, a.arr_delay AS first_arr_delay, b.flight_date AS second_date,
 b.carrier AS second_carrier, b.flight_num AS second_flight_num, b.departure_time AS second_departure_time, b.arr_delay AS second_arr_delay
 FROM best a JOIN best b ON a.dest = b.origin AND b.flight_date = CAST(a.flight_date + INTERVAL 2 DAY AS DATE) WHERE a.am_or_pm = 'AM' AND b.am_or_pm = 'PM'""",
    "p4_wire_round_trip": f"{_F} SELECT origin, dest, flight_date, carrier, flight_num, crs_dep_time, crs_dep_time AS dep_time, dep_delay, arr_delay FROM flights",
    "a10_count": f"{_F} SELECT count(*) AS n FROM flights",
    "wordcount_documents": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word",
}
ORACLE |= {
    "p1_naive_csv": ORACLE["p4_wire_round_trip"],
    "p1_strict_csv": ORACLE["p4_wire_round_trip"],
    "p12_ranked_text": ORACLE["q11_rank_tie_drop"],
    "u1_union_of_keys": ORACLE["q32_selected_keys"],
    "a9_top_lists": f"{_F}, {_cents('origin, dest', 'dep_delay')}, r AS ({_ranked('origin', 'avg_cents', 'dest').replace('<= 10', '<= 3')}) SELECT origin, string_agg(concat(dest, ':', CAST(avg_cents AS VARCHAR)), ' ' ORDER BY rank) AS best FROM r GROUP BY origin",
}
ORACLE |= {"stream_q11": ORACLE["q11_top10_airports"], "stream_q12": ORACLE["q12_top10_carriers"], "stream_q21": ORACLE["q21_top10"], "stream_q22": ORACLE["q22_top10"], "stream_q24": ORACLE["q24_mean_arrival"], "stream_q32": ORACLE["q32_best_flights"]}
