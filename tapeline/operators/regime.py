"""Trend and mean reversion of a series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.stats import line, sums
from tapeline.operators.quantiles import quantiles
from tapeline.operators.series import KEY, LENGTH, SPAN, before, in_blocks, percentiles, rolling, zscore, zscores

TIERS = (50.0, 75.0, 90.0, 95.0, 99.0, 99.5)


def linear_trend(df: DataFrame, value: str, time: str = "timestamp", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Per key: slope_per_ts, intercept, r2 and the population deviation of the residuals of value on time.

    One aggregation: Spark's regression moments are centred as they are merged.
    """
    # a pair needs both, as the moments do
    x, y = (F.when(F.col(time).isNotNull() & F.col(value).isNotNull(), F.col(c).cast("double")) for c in (time, value))
    zero = F.lit(0.0)
    agg = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.avg(x).alias("_mt"), F.avg(y).alias("_mv"),
        F.coalesce(F.regr_sxx(y, x), zero).alias("sxx"), F.coalesce(F.regr_syy(y, x), zero).alias("syy"), F.coalesce(F.regr_sxy(y, x), zero).alias("sxy"),
    ).withColumns({"sx": zero, "sy": zero})
    slope, _, r2 = line()
    return agg.select(
        *keys, "n", slope.alias("slope_per_ts"), (F.col("_mv") - slope * F.col("_mt")).alias("intercept"), r2.alias("r2"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide("syy", "n") * (1 - r2))).alias("resid_std"),
    )


def half_life(phi: Column) -> Column:
    return F.when(phi == 0, F.lit(0.0)).when(F.abs(phi) < 1, F.lit(math.log(2.0)) / -F.ln(F.abs(phi)))


def ar1(df: DataFrame, value: str, keys: tuple[str, ...] = KEY, order: str = "timestamp", span: int = SPAN) -> DataFrame:
    """Per key: n, phi, const, long_run_mean, half_life of x(t) = const + phi x(t-1), and status.

    `short` (under three values) and `constant` series have nulls. phi = 1 has no long-run mean and,
    like any |phi| of 1 or more, no half-life.
    """
    whole = df.groupBy(*keys).agg(F.avg(value).alias("c"), F.count(value).alias("m"))
    rows = before(df.select(*keys, order, value), value, "p", keys, order, span).join(whole, list(keys))
    agg = rows.groupBy(*keys, "c", "m").agg(*sums(F.col("p") - F.col("c"), F.col(value) - F.col("c")))
    slope, icept, _ = line()
    flat = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx") <= 1e-12 * F.col("n") * F.col("sxx")
    status = F.when(F.col("m") < 3, "short").when(flat, "constant").otherwise("ok")
    ok = lambda c: F.when(F.col("status") == "ok", c)
    out = agg.withColumn("status", status).withColumn("phi", ok(slope)).withColumn("const", ok(icept + F.col("c") * (1 - slope)))
    return out.select(
        *keys, F.col("m").alias("n"), "phi", "const", F.when(F.col("phi") != 1, F.try_divide("const", 1 - F.col("phi"))).alias("long_run_mean"),
        half_life(F.col("phi")).alias("half_life"), "status",
    )


def z_percentiles(df: DataFrame, value: str, window: int, keys: tuple[str, ...] = KEY, at: tuple[float, ...] = TIERS, accuracy: int | None = None) -> DataFrame:
    """Per key and percentile: |z| there, over rows with a z."""
    z = in_blocks(df, lambda rows, k: zscore(rows, value, window, k), window, max(LENGTH, window), keys=keys).filter(F.col("z").isNotNull())
    if accuracy is not None:
        return _named(z.groupBy(*keys).agg(percentiles(F.abs("z"), [a / 100 for a in at], accuracy).alias("p"), F.count("*").alias("n")), list(keys), at)
    return _named(quantiles(z, F.abs("z"), [a / 100 for a in at], keys), list(keys), at)


def _named(rows: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """A row for each percentile of p."""
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in at]).alias("percentile"), F.col("p").alias("abs_z")))
    return rows.select(*keys, "n", pairs.alias("x")).select(*keys, "n", F.col("x.percentile").alias("percentile"), F.col("x.abs_z").alias("abs_z"))


def leave_one_out_percentiles(df: DataFrame, value: str, window: int, at: tuple[float, ...] = TIERS) -> DataFrame:
    """Per product, held-out day (of any product) and percentile: |z| over all the other days."""
    z = zscores(df, value, window).filter(F.col("z").isNotNull()).select("day", "product", F.abs("z").alias("abs_z"))
    # days without any z are held out as well
    days = df.select("day", F.lit(None).cast(z.schema["product"].dataType).alias("product"), F.lit(None).cast("double").alias("abs_z")).distinct()
    rows = quantiles(z.unionByName(days), F.col("abs_z"), [a / 100 for a in at], ["product"], "day")
    return _named(rows, ["product", "held_out"], at)


def anchor_lag(df: DataFrame, value: str, window: int, time: str = "timestamp", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Per key: n, mean_lag and std_lag of the rolling mean less the fitted line, over full windows."""
    fit = linear_trend(df, value, time, keys).select(*keys, "slope_per_ts", "intercept")
    rolled = in_blocks(df, lambda rows, k: rolling(rows, value, window, k, time), window, max(LENGTH, window), keys=keys, order=time)
    full = rolled.filter(F.col("roll_n") == window).join(fit, list(keys))
    lag = F.col("roll_mean") - F.col("intercept") - F.col("slope_per_ts") * F.col(time)
    return full.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(lag).alias("mean_lag"), F.stddev_pop(lag).alias("std_lag"))
