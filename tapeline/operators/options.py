"""Implied volatilities of option quotes, their smile, expiry, reversion and break-even edges.

Quotes are rows (day, timestamp, strike, spot, price): option and spot at one tick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import pricing
from tapeline.functions.stats import about_mean, correlation, line, moments
from tapeline.operators import regime, series
from tapeline.operators.scratch import released, stored

EXPIRY = 8.25
#: Candidate expiries: a wide grid, then steps around its best one.
COARSE = [3.0 + i for i in range(38)]
FINE_BELOW, FINE_STEP, FINE_POINTS = 0.75, 0.05, 31
KEYS = ("day", "strike")


def quotes(options: DataFrame, spot: DataFrame, prefix: str) -> DataFrame:
    """Options of a tape with the spot of the same tick; ticks without either drop."""
    strike = pricing.strike_of(F.col("product"), prefix)
    rows = options.select("day", "timestamp", strike.alias("strike"), F.col("mid_price").alias("price")).filter("strike IS NOT NULL")
    return rows.join(spot.select("day", "timestamp", F.col("mid_price").alias("spot")), ["day", "timestamp"])


def implied(q: DataFrame, expiry: float = EXPIRY) -> DataFrame:
    """Quotes before expiry with tte and iv (null if no volatility gives the price)."""
    rows = q.withColumn("tte", pricing.time_to_expiry(F.col("day"), F.col("timestamp"), expiry)).filter("tte > 0")
    return rows.withColumn("iv", pricing.implied_vol(F.col("price"), F.col("spot"), F.col("strike").cast("double"), F.col("tte")))


def smile(ivs: DataFrame) -> DataFrame:
    """Per day and strike: mean and population deviation of iv, n, skipped."""
    return ivs.groupBy(*KEYS).agg(F.avg("iv").alias("mean_iv"), F.stddev_pop("iv").alias("std_iv"), F.count("iv").alias("n"), F.sum(F.col("iv").isNull().cast("long")).alias("skipped"))


def deviations(q: DataFrame) -> DataFrame:
    """Quotes with deviation: the range of the price's total deviations, solved once for all expiries."""
    return q.withColumn("deviation", pricing.deviation_range(F.col("price"), F.col("spot"), F.col("strike").cast("double")))


def _by_expiry(q: DataFrame, grid: list[float] | DataFrame, stride: int) -> DataFrame:
    """Quotes x expiries with tte and iv. A quote is solved once; a candidate costs a division and two comparisons."""
    every = series.every(q, stride, KEYS)
    every = every if "deviation" in q.columns else deviations(every)
    every = every.filter("deviation.low IS NOT NULL").select(*KEYS, "timestamp", "deviation")
    if isinstance(grid, DataFrame):
        rows = every.crossJoin(F.broadcast(grid))  # some tens of rows
    else:
        rows = every.select("*", F.explode(F.array(*[F.lit(float(d)) for d in grid])).alias("expiry"))
    rows = rows.withColumn("tte", F.col("expiry") - F.col("day") - F.col("timestamp") / F.lit(1_000_000.0)).filter("tte > 0")
    iv = pricing.vol_of_deviation(F.col("deviation"), F.col("tte"))
    return rows.withColumn("iv", iv).filter("iv IS NOT NULL")


def expiry_scores(q: DataFrame, grid: list[float] | DataFrame, stride: int = 1) -> DataFrame:
    """expiry, dispersion: (max - min) / mean over days of each day's mean iv; expiries at which a day
    has no iv have none. The grid is exploded per quote."""
    days = q.select("day").distinct().agg(F.count("*").alias("days"))
    means = _by_expiry(q, grid, stride).groupBy("expiry", "day").agg(F.avg("iv").alias("m"))
    agg = means.groupBy("expiry").agg(F.try_divide(F.max("m") - F.min("m"), F.avg("m")).alias("dispersion"), F.count("*").alias("n"))
    return agg.crossJoin(F.broadcast(days)).filter("n = days").select("expiry", "dispersion")  # one row


def calibrated_expiry(scored: DataFrame) -> DataFrame:
    """One row: the expiry of the least dispersion, of equals the first."""
    best = F.min_by(F.struct("expiry", "dispersion"), F.struct(F.round("dispersion", 12), F.col("expiry")))
    return scored.agg(best.alias("b")).select("b.expiry", "b.dispersion")


def fine_grid(coarse: DataFrame) -> DataFrame:
    """expiry: the fine grid around the best of a scored coarse one; empty if none has a score."""
    best = calibrated_expiry(coarse).filter("expiry IS NOT NULL")
    return best.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(FINE_POINTS - 1)), lambda i: F.col("expiry") - FINE_BELOW + F.lit(FINE_STEP) * i)).alias("expiry"))


def expiry_scan(q: DataFrame) -> DataFrame:
    """scan (coarse or fine), expiry, dispersion over all quotes: a wide grid, then a fine one around its best.

    Quotes with their deviations are stored for the second grid, and so is the coarse scan.
    """
    solved = stored(deviations(q).select(*KEYS, "timestamp", "deviation"), "deviations")
    coarse = stored(expiry_scores(solved, COARSE), "coarse")
    fine = expiry_scores(solved, fine_grid(coarse))
    found = stored(coarse.select(F.lit("coarse").alias("scan"), "*").unionByName(fine.select(F.lit("fine").alias("scan"), "*")), "scan")
    released(solved, coarse)
    return found


def scanned_by_strike(q: DataFrame) -> DataFrame:
    """calibrated_expiry_by_strike over the fine grid around the best expiry of all strikes, quotes solved once."""
    solved = stored(deviations(q).select(*KEYS, "timestamp", "deviation"), "deviations")
    grid = stored(fine_grid(expiry_scores(solved, COARSE)), "grid")
    found = stored(calibrated_expiry_by_strike(solved, grid), "by_strike")
    released(solved, grid)
    return found


def calibrated_expiry_by_strike(q: DataFrame, grid: list[float] | DataFrame, stride: int = 1) -> DataFrame:
    """Per strike: the expiry of the least dispersion over days; expiries without all days don't count."""
    days = q.select("day").distinct().agg(F.count("*").alias("days"))
    means = _by_expiry(q, grid, stride).groupBy("strike", "expiry", "day").agg(F.avg("iv").alias("m"))
    agg = means.groupBy("strike", "expiry").agg(F.try_divide(F.max("m") - F.min("m"), F.avg("m")).alias("d"), F.count("*").alias("n"))
    agg = agg.crossJoin(F.broadcast(days)).filter("n = days AND d IS NOT NULL")  # one row
    return agg.groupBy("strike").agg(F.min_by(F.struct("expiry", "d"), F.struct(F.round("d", 12), F.col("expiry"))).alias("b")).select("strike", "b.expiry", F.col("b.d").alias("dispersion"))


def trend_consistency(ivs: DataFrame, least: int = 5) -> DataFrame:
    """Per day and strike with enough ivs: |slope of iv on timestamp| over the mean iv."""
    fits = regime.linear_trend(ivs.filter("iv IS NOT NULL"), "iv", keys=KEYS).filter(F.col("n") >= least)
    means = ivs.groupBy(*KEYS).agg(F.avg("iv").alias("m"))
    return fits.join(means, list(KEYS)).select(*KEYS, "n", F.try_divide(F.abs("slope_per_ts"), F.col("m")).alias("relative_slope"))


def reversion(ivs: DataFrame) -> DataFrame:
    """AR(1) of the iv per day and strike."""
    return regime.ar1(ivs.filter("iv IS NOT NULL"), "iv", KEYS).filter("n >= 3")


def single_edges(ivs: DataFrame, spreads: DataFrame, vega_stride: int = 500) -> DataFrame:
    """Per day and strike: how many deviations of iv pay the spread. spreads: day, strike, mean_spread."""
    valid = ivs.filter("iv IS NOT NULL")
    v = pricing.vega(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("iv"))
    vegas = series.every(valid, vega_stride, KEYS).groupBy(*KEYS).agg(F.avg(v).alias("vega"))
    out = smile(ivs).filter("n >= 3").join(vegas, list(KEYS)).join(spreads, list(KEYS)).join(reversion(ivs).select(*KEYS, "half_life"), list(KEYS), "left")
    out = out.withColumn("price_std", F.col("std_iv") * F.col("vega"))
    z = F.when(F.col("price_std") > 0, F.col("mean_spread") / F.col("price_std")).otherwise(F.lit(float("inf")))
    return out.select(*KEYS, "n", "std_iv", "vega", "price_std", "mean_spread", z.alias("breakeven_z"), "half_life")


def pair_edges(ivs: DataFrame, spreads: DataFrame, vega_stride: int = 500) -> DataFrame:
    """The same for the gap between the ivs of neighbouring strikes at common ticks."""
    valid = ivs.filter("iv IS NOT NULL")
    strikes = ivs.select("strike").distinct()
    nearby = strikes.withColumn("above", F.lead("strike").over(Window.orderBy("strike"))).filter("above IS NOT NULL")  # a few strikes
    low = valid.select("day", "timestamp", "strike", "spot", "tte", "iv").join(nearby, "strike")
    high = valid.select("day", "timestamp", F.col("strike").alias("above"), F.col("iv").alias("iv_above"))
    gap = low.join(high, ["day", "timestamp", "above"]).withColumn("gap", F.col("iv_above") - F.col("iv"))
    v = (pricing.vega(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("iv")) + pricing.vega(F.col("spot"), F.col("above").cast("double"), F.col("tte"), F.col("iv_above"))) / F.lit(2.0)
    vegas = series.every(gap, vega_stride, KEYS).groupBy(*KEYS).agg(F.avg(v).alias("vega"))
    stats = gap.groupBy(*KEYS, "above").agg(F.stddev_pop("gap").alias("std_gap"), F.count("*").alias("n")).filter("n >= 3")
    fits = regime.ar1(gap, "gap", KEYS).select(*KEYS, "half_life")
    cost = spreads.select("day", F.col("strike").alias("above"), F.col("mean_spread").alias("_s"))
    out = stats.join(vegas, list(KEYS)).join(spreads, list(KEYS)).join(cost, ["day", "above"]).join(fits, list(KEYS), "left")
    out = out.withColumn("cost", F.col("mean_spread") + F.col("_s")).withColumn("price_std", F.col("std_gap") * F.col("vega"))
    z = F.when(F.col("price_std") > 0, F.col("cost") / F.col("price_std")).otherwise(F.lit(float("inf")))
    return out.select(*KEYS, "above", "n", "std_gap", "vega", "price_std", "cost", z.alias("breakeven_z"), "half_life")


def level_regression(q: DataFrame) -> DataFrame:
    """Per day and strike: correlation, slope and r2 of the option's price on the spot."""
    stats = about_mean(q.groupBy(*KEYS).agg(*moments(F.col("spot"), F.col("price"))), list(KEYS))
    slope, _, r2 = line()
    return stats.select(*KEYS, F.col("n").cast("long").alias("n"), correlation(0.0).alias("corr"), slope.alias("slope"), r2.alias("r2"))


def thin(scan: DataFrame, every: int) -> DataFrame:
    """Rows 0, every, 2 every, ... of each scan (scan, expiry, dispersion) by expiry, and its best: of the
    least dispersion, of equals the first. A scan is a grid: a handful of rows."""
    by = Window.partitionBy("scan")
    best = F.first("expiry").over(by.orderBy(F.col("dispersion").asc_nulls_last(), "expiry"))
    rows = scan.withColumn("_i", F.row_number().over(by.orderBy("expiry")) - 1).withColumn("_best", best)
    return rows.filter((F.col("_i") % every == 0) | (F.col("expiry") == F.col("_best"))).drop("_i", "_best")
