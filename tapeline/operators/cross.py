"""Structure across assets: basket identities, correlations, lead and lag, pairs.

Panels stay long: (day, timestamp, family, product, mid_price). All fits come from sums per day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import SUMS, about_mean, correlation, line, merged, moments, sums
from tapeline.operators import book, regime, series
from tapeline.operators.bootstrap import block_bootstrap_trend, oriented_p, resampled_sums, unit_draws
from tapeline.operators.quantiles import quantiles

IDENTITY = 0.999


def _fits(stats: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Pooled slope, intercept and r2 per keys, with min_day_r2 over days and identity."""
    slope, icept, r2 = line()
    pooled = stats.groupBy(*keys).agg(*merged()).select(*keys, F.col("n").cast("long").alias("n"), slope.alias("slope"), icept.alias("intercept"), r2.alias("r2"))
    days = stats.select(*keys, day, r2.alias("day_r2")).groupBy(*keys).agg(F.min("day_r2").alias("min_day_r2"))
    return pooled.join(days, keys).withColumn("identity", (F.col("r2") >= IDENTITY) & (F.col("min_day_r2") >= IDENTITY))


def within_families(panel: DataFrame) -> DataFrame:
    """Each member on the sum of the others of its family. Days are summed about their own means, and those sums are
    then moved to the mean of all days."""
    keys = ["family", "product"]
    rows = series.family_totals(panel)
    stats = about_mean(rows.groupBy(*keys, "day").agg(*moments(F.col("others"), F.col("mid_price"))), keys)
    means = stats.select(*keys, "_mx", "_my").distinct()
    out = _fits(stats, keys).join(means, keys)
    return out.withColumn("intercept", F.col("intercept") + F.col("_my") - F.col("slope") * F.col("_mx")).drop("_mx", "_my")


def across_families(panel: DataFrame) -> DataFrame:
    """Each product on the total of every other family."""
    totals = panel.groupBy("day", "timestamp", F.col("family").alias("other")).agg(F.sum("mid_price").alias("total"))
    pairs = panel.join(totals, ["day", "timestamp"]).filter("family <> other")
    keys = ["family", "product", "other"]
    stats = about_mean(pairs.groupBy(*keys, "day").agg(*moments(F.col("total"), F.col("mid_price"))), keys)
    return _fits(stats, keys).drop("intercept")


def ranked_fits(fits: DataFrame) -> DataFrame:
    """Fits of families with rank: 1 for the largest r2 of a family, of equals the first product."""
    return fits.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.round("r2", 9).desc(), "product")))


def ranked_leads(found: DataFrame) -> DataFrame:
    """lead_lag() with rank: 1 for the largest |peak| of a family, of equals the first leader and follower."""
    order = Window.partitionBy("family").orderBy(F.round(F.abs("peak"), 9).desc(), "leader", "follower")
    return found.withColumn("rank", F.row_number().over(order))


def changes(panel: DataFrame) -> DataFrame:
    """First differences within a day, with their index i from 0."""
    rows = series.first_difference(panel, "mid_price", "change")
    return rows.select("day", "family", "product", "change", (F.row_number().over(series.in_order()) - 1).alias("i"))


def family_correlations(panel: DataFrame) -> DataFrame:
    """day, family, a, b, corr of the members' changes (ordered pairs with the diagonal); without
    variance 1 on the diagonal and 0 off it."""
    c = changes(panel)
    left = c.select("day", "family", "i", F.col("product").alias("a"), F.col("change").alias("x"))
    right = c.select("day", "family", "i", F.col("product").alias("b"), F.col("change").alias("y"))
    stats = left.join(right, ["day", "family", "i"]).groupBy("day", "family", "a", "b").agg(*sums(F.col("x"), F.col("y")))
    corr = F.coalesce(correlation(None), F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return stats.select("day", "family", "a", "b", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(corr).alias("corr"))


def mean_off_diagonal(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: mean and mean absolute correlation of different members."""
    return matrix.filter("a <> b").groupBy(*keys).agg(F.avg("corr").alias("mean_corr"), F.avg(F.abs("corr")).alias("mean_abs_corr"), F.count("*").alias("pairs"))


def lag_sums(panel: DataFrame, lags: list[int], length: int = series.LENGTH) -> DataFrame:
    """family, leader, follower, lag, day and the sums of the leader's change at i with the follower's at i + lag.

    A family's rows of a day go to blocks of `length` indices, each with the rows that its lags reach beyond it: rows are
    shuffled once, not once a lag. Blocks' sums add up.
    """
    c = changes(panel)
    low, high = min(0, *lags), max(0, *lags)
    own = F.floor(F.col("i") / length)
    # a row is a follower of the blocks whose leaders are up to `high` before and `-low` behind it
    c = c.withColumn("block", F.explode(F.sequence(F.floor((F.col("i") - high) / length), F.floor((F.col("i") - low) / length)))).filter("block >= 0").withColumn("leads", F.col("block") == own)
    kinds = dict(c.dtypes)
    names = f"family {kinds['family']}, leader {kinds['product']}, follower {kinds['product']}, lag int, day {kinds['day']}, " + ", ".join(f"{n} double" for n in SUMS)

    def sums_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        day, family, block = key
        start, size, out = int(block) * length + low, length + high - low, []
        series_ = {}
        for product, part in rows.groupby("product"):
            value, known = np.zeros(size), np.zeros(size, bool)
            at = part["i"].to_numpy() - start
            value[at], known[at] = part["change"].to_numpy(), True
            series_[product] = value, known, bool(part["leads"].any())
        for leader, (v, k, leads) in series_.items():
            for follower, (w, m, _) in series_.items():
                for lag in lags if leads and leader != follower else ():
                    both = k[-low : length - low] & m[lag - low : lag - low + length]
                    x, y = v[-low : length - low][both], w[lag - low : lag - low + length][both]
                    if len(x):
                        out.append((family, leader, follower, lag, day, float(len(x)), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()))
        return pd.DataFrame(out, columns=["family", "leader", "follower", "lag", "day", *SUMS])

    blocks = c.groupBy("day", "family", "block").applyInPandas(sums_of, names)
    return blocks.groupBy("family", "leader", "follower", "lag", "day").agg(*merged())


def lead_lag(stats: DataFrame) -> DataFrame:
    """Per ordered pair: the lag of the largest |corr| (of equals the smallest lag) and that corr."""
    keys = ["family", "leader", "follower"]
    pooled = stats.groupBy(*keys, "lag").agg(*merged()).select(*keys, "lag", correlation(0.0).alias("corr"))
    best = F.max_by(F.struct("lag", "corr"), F.struct(F.round(F.abs("corr"), 12), -F.col("lag")))
    return pooled.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.lag").alias("peak_lag"), F.col("b.corr").alias("peak"))


def lead_lag_bootstrap(stats: DataFrame, replicates: int, seed: int) -> DataFrame:
    """lead_lag() with the interval and p of the peak from resampled days."""
    keys = ["family", "leader", "follower"]
    peaks = lead_lag(stats)
    at_peak = stats.join(peaks.select(*keys, F.col("peak_lag").alias("lag")), [*keys, "lag"]).drop("lag")
    draws = unit_draws(stats.select("day").distinct(), "day", replicates, seed)
    again = resampled_sums(at_peak, "day", keys, draws).select(*keys, "replicate", correlation(0.0).alias("again"))
    return peaks.join(oriented_p(F.col("peak"), "again", keys, replicates, again.join(peaks, keys)), keys)


def lead_lag_summary(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per family: pairs, those whose peak is not at lag 0, and those significant."""
    n = lambda c: F.sum(c.cast("long"))
    return found.groupBy("family").agg(F.count("*").alias("pairs"), n(F.col("peak_lag") != 0).alias("off_zero"), n((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


def best_per_family(fits: DataFrame) -> DataFrame:
    return fits.groupBy("family").agg(F.max_by(F.struct("product", "r2"), F.struct(F.round("r2", 9), "product")).alias("b")).select("family", "b.product", "b.r2")


def greedy_pairs(edges: DataFrame) -> DataFrame:
    """Disjoint pairs (a < b) of each group, strongest first: group, a, b, weight. edges: the same, in any order and with
    both directions; ties break by a, then b.

    A group's edges become one sorted array (as many as pairs of its members), along which pairs are taken unless a member
    is taken already. One job, whatever the groups.
    """
    edge = F.struct((-F.round(F.abs("weight"), 9)).alias("k"), "a", "b", "weight")
    sorted_ = edges.filter("a < b").groupBy("group").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    none = F.filter("edges", lambda e: F.lit(False))

    def take(taken: Column, e: Column) -> Column:
        busy = F.exists(taken, lambda t: t["a"].isin(e["a"], e["b"]) | t["b"].isin(e["a"], e["b"]))
        return F.when(busy, taken).otherwise(F.concat(taken, F.array(e)))

    picked = sorted_.select("group", F.explode(F.aggregate("edges", none, take)).alias("e"))
    return picked.select("group", "e.a", "e.b", "e.weight")


def pair_spread(prices: DataFrame, a, b) -> DataFrame:
    """day, timestamp, spread: mid of a less mid of b."""
    x = prices.filter(F.col("product") == a).select("day", "timestamp", F.col("mid_price").alias("x"))
    y = prices.filter(F.col("product") == b).select("day", "timestamp", F.col("mid_price").alias("y"))
    return x.join(y, ["day", "timestamp"]).select("day", "timestamp", (F.col("x") - F.col("y")).alias("spread"))


def pair_diagnostics(prices: DataFrame, a, b, window: int = 1000, length: int = 200, replicates: int = 2000, seed: int = 1, costs: DataFrame | None = None) -> DataFrame:
    """Per day: AR(1) of the spread, p of its trend, median rolling deviation, cost of a round trip.

    costs: day, product, median_spread; by default from the tape's touch spreads.
    """
    s = pair_spread(prices, a, b)
    fit = regime.ar1(s, "spread", ("day",)).select("day", "phi", "half_life")
    trend = block_bootstrap_trend(s, "spread", ["day"], "timestamp", length, replicates, seed).select("day", F.col("p").alias("trend_p"))
    roll = series.in_blocks(s, lambda rows, keys: series.rolling(rows, "spread", window, keys), window, max(series.LENGTH, window), keys=("day",))
    roll = roll.filter((F.col("roll_n") == window) & (F.col("roll_std") > 0))
    roll = quantiles(roll, F.col("roll_std"), [0.5], ["day"]).select("day", F.get("p", F.lit(0)).alias("rolling_std"))
    costs = book.spread_stats(prices) if costs is None else costs
    cost = costs.filter(F.col("product").isin(a, b)).groupBy("day").agg(F.sum("median_spread").alias("round_trip_cost"))
    out = fit.join(trend, "day", "left").join(roll, "day", "left").join(cost, "day", "left")
    return out.withColumn("amplitude_over_cost", F.try_divide("rolling_std", "round_trip_cost"))


def basket_residuals(panel: DataFrame, target: float) -> DataFrame:
    """Per family and day: deviation and 90th and 99th percentiles of |sum of members - target|."""
    r = panel.groupBy("day", "timestamp", "family").agg((F.sum("mid_price") - F.lit(target)).alias("r"))
    agg = r.groupBy("day", "family").agg(F.stddev_pop("r").alias("std"), F.percentile(F.abs("r"), F.array(F.lit(0.9), F.lit(0.99))).alias("p"), F.count("*").alias("n"))
    return agg.select("day", "family", "n", "std", F.get("p", F.lit(0)).alias("p90"), F.get("p", F.lit(1)).alias("p99"))
