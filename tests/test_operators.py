import math
from datetime import date

import numpy as np
import pytest
from aerolytics import operators as op
from aerolytics.functions import am_or_pm, cents_half_up, hhmm_pretty, parse_double, parse_long, strip_quotes, two_decimals
from aerolytics.operators import stats
from pyspark.sql import functions as F

FLIGHTS = "origin string, dest string, flight_date date, carrier string, flight_num string, crs_dep_time string, dep_delay double, arr_delay double"


def flights(spark, *rows):
    base = {"origin": "AAA", "dest": "BBB", "flight_date": date(2008, 1, 1), "carrier": "XX", "flight_num": "1", "crs_dep_time": "0900", "dep_delay": 0.0, "arr_delay": 0.0}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], FLIGHTS)


def test_scalars(spark):
    d = spark.createDataFrame([("1159",), ("1200",), ("0000",), ("2400",), ("705",), ("x",), (None,)], "t string")
    got = [tuple(r) for r in d.select(am_or_pm("t"), hhmm_pretty("t")).collect()]
    assert got == [("AM", "11:59"), ("PM", "12:00"), ("AM", "00:00"), ("PM", "24:00"), ("PM", None), (None, None), (None, None)]
    n = spark.createDataFrame([(" 1.5 ",), ("abc",), ("NaN",), ("",), ("Infinity",)], "t string")
    assert [r[0] for r in n.select(parse_double("t")).collect()] == [1.5, None, None, None, None]
    row = spark.range(1).select(two_decimals(F.lit(0.125)), cents_half_up(F.lit(-1.0), F.lit(8)), parse_long(F.lit(" 7")), strip_quotes(F.lit('"a"'))).first()
    assert tuple(row) == ("0.13", -13, 7, "a")


def test_ranking(spark):
    d = spark.createDataFrame([("a", 5), ("b", 7), ("c", 5), ("d", 1)], "airport string, n long")
    assert [r.airport for r in op.top(d, "n", "airport", 3).collect()] == ["b", "a", "c"]
    assert [(r.n, r.airport) for r in op.first_per_count(d, "n", "airport").collect()] == [(7, "b"), (5, "a"), (1, "d")]
    assert [r.airport for r in op.rank_all(d, "n", "airport").collect()] == ["b", "a", "c", "d"]
    text = spark.createDataFrame([("San Juan\t12",), ("JFK\t7",), ("bad\tx",)], "value string")
    assert [(r.airport, r.n) for r in op.first_token_counts(text).collect()] == [("San", 12), ("JFK", 7)]


def test_top_lists_do_not_pad_and_ties_go_by_name(spark):
    f = flights(spark, *[{"carrier": c, "dep_delay": d} for c, d in (("B", 1.004), ("A", 1.0), ("C", None), ("D", 2.0))])
    m = op.mean_delay(f, ["origin", "carrier"], "dep_delay")
    assert [(r.carrier, r["rank"]) for r in op.smallest_per(m, "origin", "avg_delay", "carrier").orderBy("rank").collect()] == [("A", 1), ("B", 2), ("D", 3)]
    assert [x.carrier for x in op.top_list_per(m, "origin", "avg_delay", "carrier", 2).first().best] == ["A", "B"]
    c = op.mean_delay_cents(f, ["carrier"], "dep_delay")
    assert [r.carrier for r in op.smallest(c, "avg_cents", ["carrier"]).collect()] == ["A", "B", "D"]
    assert op.selected(m, "carrier", ["A", "Z"]).count() == 1


def test_best_flights_and_trips(spark):
    f = flights(
        spark, {"arr_delay": 3.0}, {"arr_delay": -2.0, "carrier": "ZZ"}, {"arr_delay": -2.0, "carrier": "YY", "flight_num": "9"}, {"crs_dep_time": "705", "arr_delay": -99.0}, {"origin": "AAAA", "arr_delay": -99.0}, {"arr_delay": None},
        {"origin": "BBB", "dest": "CCC", "flight_date": date(2008, 1, 3), "crs_dep_time": "1300", "arr_delay": 1.0}, {"origin": "BBB", "dest": "CCC", "flight_date": date(2008, 1, 3), "crs_dep_time": "1100"}, {"flight_date": date(2007, 5, 5)},
    )
    best = op.best_flights(f, 2008).cache()
    assert best.count() == 3
    assert tuple(op.lookup(best, "AAA", "BBB", "2008-01-01", "AM").first()) == ("YY", "9", "09:00", -2.0)
    assert op.lookup(best, "AAA", "CCC", "2008-01-01", "AM").isEmpty()
    trip = op.two_leg_trips(best).collect()
    assert len(trip) == 1 and (trip[0].x, trip[0].y, trip[0].z, trip[0].first_carrier, trip[0].second_departure_time) == ("AAA", "BBB", "CCC", "YY", "13:00")
    legs = [op.lookup(best, "AAA", "BBB", "2008-01-01", "AM").first(), op.lookup(best, "BBB", "CCC", "2008-01-03", "PM").first()]
    assert [(x.carrier, x.arr_delay) for x in legs] == [(trip[0].first_carrier, trip[0].first_arr_delay), (trip[0].second_carrier, trip[0].second_arr_delay)]
    assert op.messages_best(best).filter("value LIKE 'AAA BBB 2008-01-01 AM YY 9 09:00 -2.0'").count() == 1
    assert op.pick_keys(best, [("AAA", "BBB", "2008-01-01", "AM")]).count() == 1


def counts(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "n double")


def brute_fit(x):
    """Every distinct value but the largest as xmin, element by element."""
    x, best = np.sort(np.asarray(x, float)), None
    for xmin in np.unique(x)[:-1]:
        tail = x[x >= xmin]
        alpha = 1 + len(tail) / np.log(tail / xmin).sum()
        d = np.abs(np.arange(len(tail)) / len(tail) - (1 - (tail / xmin) ** (1 - alpha))).max()
        if best is None or d < best[0] - 1e-12:
            best = (d, xmin, alpha, len(tail))
    return best


def brute_ratio(x, xmin, alpha, mu, sigma):
    x = np.asarray(x, float)
    x = x[x >= xmin]
    power = np.log((alpha - 1) / xmin) - alpha * np.log(x / xmin)
    z = (np.log(x) - mu) / sigma
    log = -np.log(x * sigma * math.sqrt(2 * math.pi)) - z * z / 2 - math.log(0.5 * math.erfc((math.log(xmin) - mu) / sigma / math.sqrt(2)))
    g = power - log
    return g.sum() / (g.std() * math.sqrt(len(g)))


def test_power_law_and_lognormal(spark):
    r = np.random.default_rng(0)
    x = np.round(10 * (1 - r.random(600)) ** (-1 / 1.5), 1)
    d = counts(spark, x)
    fit = op.fit_power_law(d, "n")
    gap, xmin, alpha, n = brute_fit(x)
    assert (fit["xmin"], fit["n_tail"]) == (xmin, n) and abs(fit["alpha"] - alpha) < 1e-9 and abs(fit["D"] - gap) < 1e-9
    assert abs(fit["alpha"] - 2.5) < 0.4
    both = op.likelihood_ratio(d, "n")
    assert abs(both["R"] - brute_ratio(x, xmin, alpha, both["mu"], both["sigma"])) < 1e-6 and both["R"] > -1.5
    assert abs(both["p"] - math.erfc(abs(both["R"]) / math.sqrt(2))) < 1e-12
    with pytest.raises(ValueError):
        op.fit_power_law(counts(spark, [3, 3, 3]), "n")


def test_lognormal_fits(spark):
    r = np.random.default_rng(1)
    y = np.exp(r.normal(5, 1.2, 4000))
    d = counts(spark, y)
    whole = op.lognormal_whole(d, "n").first()
    assert abs(whole.mu - np.log(y).mean()) < 1e-9 and abs(whole.sigma - np.log(y).std()) < 1e-9
    # cut off at the median, the fit still finds the whole law; near its optimum no other pair is likelier
    xmin = float(np.median(y))
    fit = op.fit_lognormal(d, "n", xmin)
    assert abs(fit["mu"] - 5) < 0.25 and abs(fit["sigma"] - 1.2) < 0.15
    tail = y[y >= xmin]
    cost = lambda mu, sigma: stats._lognormal_cost(len(tail), np.log(tail).sum(), (np.log(tail) ** 2).sum(), mu, sigma, xmin)
    best = cost(fit["mu"], fit["sigma"])
    assert all(cost(fit["mu"] + a, fit["sigma"] + b) >= best - 1e-6 for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))
    direct = -(-np.log(tail * 1.2 * math.sqrt(2 * math.pi)) - ((np.log(tail) - 5) / 1.2) ** 2 / 2 - math.log(0.5 * math.erfc((math.log(xmin) - 5) / 1.2 / math.sqrt(2)))).sum()
    assert abs(cost(5.0, 1.2) - direct) < 1e-6


def test_fits_over_frames(spark):
    r = np.random.default_rng(2)
    values = [int(v) for v in 5 * (1 - r.random(1500)) ** (-1 / 1.2)]
    d = spark.createDataFrame([(v,) for v in values], "n long")
    fit = op.fit_power_law(d, "n")
    row = op.power_law_alpha(d, "n", fit["xmin"]).first()
    assert row.n_tail == fit["n_tail"] and abs(row.alpha - fit["alpha"]) < 1e-9
    c = {x.n: x.n_at_least for x in op.ccdf(d, "n").collect()}
    assert all(k == sum(v >= x for v in values) for x, k in c.items())


def test_coded_rows_and_endpoint_counts(spark):
    f = flights(spark, {}, {}, {"dest": "AAA"}, {"origin": "LONG"}, {"dest": None})
    assert {r.airport: r.n for r in op.endpoint_counts(f).collect()} == {"AAA": 5, "BBB": 3, "LONG": 1, None: 1}
    assert op.coded(f, "origin", "dest").count() == 3 and op.coded(f, "dest").count() == 4


def test_word_counts_keep_empty_strings(spark):
    d = spark.createDataFrame([("a  b a",)], "value string")
    assert {r.word: r.n for r in op.word_counts(d).collect()} == {"a": 2, "": 1, "b": 1}


def test_plans(spark):
    """Key filters reach the scan, rankings are cut before the shuffle, averages are summed before it."""
    from aerolytics.plans import flights as view

    f = view(spark, "/root/testdata/sf0.001")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    top = plan(op.smallest_per(op.mean_delay(f, ["origin", "carrier"], "dep_delay"), "origin", "avg_delay", "carrier"))
    assert "WindowGroupLimit" in top and "partial_avg" in top and "l_shipdate" not in top
    assert "TakeOrderedAndProject" in plan(op.top(op.endpoint_counts(f), "n", "airport"))
    assert "Python" not in top
