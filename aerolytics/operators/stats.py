"""Is popularity a power law? Fits after Clauset, Shalizi and Newman (2009) and Vuong's (1989) test.

Spark groups the counts by value and makes every sum; the driver sees one row of sums at a time: the best candidate
xmin, the three sums that a lognormal fit needs, and the two of the likelihood ratio. Candidates for xmin are compared with
the distinct values above them, so the work grows with the square of the number of distinct values (of airports: hundreds).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ccdf(counts: DataFrame, value: str) -> DataFrame:
    """P(X >= x) at each distinct x, as whole numbers: n_at_least of n_all.

    Grouped by value first, so the one ordered window sees distinct values only."""
    by = counts.groupBy(value).agg(F.count("*").alias("k"))
    down = W.orderBy(F.desc(value))
    return by.select(value, F.sum("k").over(down).alias("n_at_least"), F.sum("k").over(W.partitionBy()).alias("n_all"))


def value_counts(counts: DataFrame, value: str) -> DataFrame:
    """x (a distinct value above 0) and k, how many keys have it."""
    return counts.filter(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k"))


def power_law_alpha(counts: DataFrame, value: str, xmin: float) -> DataFrame:
    """The exponent by maximum likelihood for a given xmin: 1 + n / sum(ln(x / xmin))."""
    tail = counts.filter(F.col(value) >= xmin)
    return tail.agg(F.count("*").alias("n_tail"), (1 + F.count("*") / F.sum(F.log(F.col(value) / xmin))).alias("alpha"))


def power_law_scan(counts: DataFrame, value: str) -> DataFrame:
    """xmin (every distinct value but the largest), n_tail, alpha and D, the largest distance of the fitted from the empirical tail.

    Sums over a tail are running sums over distinct values. Of k equal values the first and the last lie farthest from the fit."""
    down = W.orderBy(F.desc("x"))
    v = value_counts(counts, value)
    v = v.withColumns({"at_least": F.sum("k").over(down), "logs": F.sum(F.col("k") * F.log("x")).over(down), "top": F.max("x").over(W.partitionBy())})
    spread = F.col("logs") - F.col("at_least") * F.log("x")
    tails = v.filter((F.col("x") < F.col("top")) & (spread > 0)).select(F.col("x").alias("xmin"), F.col("at_least").alias("n_tail"), (1 + F.col("at_least") / spread).alias("alpha"))
    pairs = tails.join(v.select("x", "k", "at_least"), F.col("x") >= F.col("xmin"))
    fitted = 1 - F.pow(F.col("x") / F.col("xmin"), 1 - F.col("alpha"))
    before = F.col("n_tail") - F.col("at_least")
    gap = F.greatest(F.abs(before / F.col("n_tail") - fitted), F.abs((before + F.col("k") - 1) / F.col("n_tail") - fitted))
    return pairs.groupBy("xmin", "n_tail", "alpha").agg(F.max(gap).alias("D"))


def best_power_law(counts: DataFrame, value: str) -> DataFrame:
    """The row of least D (to nine digits; then the least xmin); none if there are fewer than two distinct values."""
    return power_law_scan(counts, value).orderBy(F.round("D", 9), "xmin").limit(1)


def fit_power_law(counts: DataFrame, value: str) -> dict[str, float]:
    """xmin, alpha, D and n_tail; xmin is the value at which the fitted tail lies nearest to the data."""
    row = best_power_law(counts, value).first()
    if row is None:
        raise ValueError("needs two distinct values")
    return row.asDict()


def log_sums(counts: DataFrame, value: str, xmin: float = 0.0) -> DataFrame:
    """n, s1 and s2 of the values from xmin: how many, the sum of ln x and of its square. All that a lognormal fit needs."""
    v = value_counts(counts, value).filter(F.col("x") >= xmin)
    return v.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("x")).alias("s1"), F.sum(F.col("k") * F.log("x") ** 2).alias("s2"))


def lognormal_whole(counts: DataFrame, value: str) -> DataFrame:
    """mu and sigma of a lognormal over all values above 0, by maximum likelihood."""
    mean = F.col("s1") / F.col("n")
    return log_sums(counts, value).select("n", mean.alias("mu"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("sigma"))


def log_sf(z: float) -> float:
    """ln P(Z > z) of a standard normal."""
    if z < 30:
        return math.log(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def _lognormal_cost(n: float, s1: float, s2: float, mu: float, sigma: float, xmin: float) -> float:
    """Minus the log likelihood of the tail from xmin, by its sums."""
    if sigma <= 1e-6:
        return math.inf
    squares = (s2 - 2 * mu * s1 + n * mu * mu) / (sigma * sigma)
    return s1 + n * math.log(sigma * math.sqrt(2 * math.pi)) + squares / 2 + n * log_sf((math.log(xmin) - mu) / sigma)


def _nelder_mead(f, start: list[float], step: float = 0.05, rounds: int = 2000, tol: float = 1e-10) -> np.ndarray:
    pts = [np.array(start, float)]
    for i in range(len(start)):
        p = pts[0].copy()
        p[i] += step * (abs(p[i]) or 1)
        pts.append(p)
    vals = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol and np.abs(pts[-1] - pts[0]).max() < 1e-8:
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        got = f(far)
        if got < vals[0]:
            further = mid + 2 * (mid - pts[-1])
            more = f(further)
            pts[-1], vals[-1] = (further, more) if more < got else (far, got)
        elif got < vals[-2]:
            pts[-1], vals[-1] = far, got
        else:
            near = mid + 0.5 * ((far if got < vals[-1] else pts[-1]) - mid)
            less = f(near)
            if less < min(got, vals[-1]):
                pts[-1], vals[-1] = near, less
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def fit_lognormal(counts: DataFrame, value: str, xmin: float) -> dict[str, float]:
    """mu and sigma of a lognormal cut off below xmin."""
    n, s1, s2 = (float(x) for x in log_sums(counts, value, xmin).first())
    start = [s1 / n, math.sqrt(max(0.0, s2 / n - (s1 / n) ** 2)) or 1.0]
    mu, sigma = _nelder_mead(lambda p: _lognormal_cost(n, s1, s2, p[0], p[1], xmin), start)
    return {"mu": float(mu), "sigma": float(sigma)}


def _gap(x: Column, xmin: float, alpha: float, mu: float, sigma: float) -> Column:
    """The log likelihood of x by the power law less that by the lognormal."""
    power = math.log((alpha - 1) / xmin) - alpha * F.log(x / xmin)
    z = (F.log(x) - mu) / sigma
    return power + F.log(x) + math.log(sigma * math.sqrt(2 * math.pi)) + z * z / 2 + log_sf((math.log(xmin) - mu) / sigma)


def ratio(counts: DataFrame, value: str, xmin: float, alpha: float, mu: float, sigma: float) -> DataFrame:
    """n and R, Vuong's normalised log likelihood ratio of both laws over the values from xmin: the sum of the gaps over their deviation times sqrt(n)."""
    v = value_counts(counts, value).filter(F.col("x") >= xmin).withColumn("g", _gap(F.col("x"), xmin, alpha, mu, sigma))
    sums = v.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("g")).alias("a"), F.sum(F.col("k") * F.col("g") * F.col("g")).alias("b"))
    spread = F.col("b") / F.col("n") - (F.col("a") / F.col("n")) ** 2
    return sums.select("n", F.when(spread > 0, F.col("a") / F.sqrt(spread * F.col("n"))).otherwise(0.0).alias("R"))


def likelihood_ratio(counts: DataFrame, value: str) -> dict[str, float]:
    """Both fits and Vuong's normalised ratio R with its p: R < 0 favours the lognormal."""
    fit = fit_power_law(counts, value)
    fit |= fit_lognormal(counts, value, fit["xmin"])
    norm = float(ratio(counts, value, fit["xmin"], fit["alpha"], fit["mu"], fit["sigma"]).first()["R"])
    return fit | {"R": norm, "p": math.erfc(abs(norm) / math.sqrt(2))}
