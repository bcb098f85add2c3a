"""Series of a (day, product) key in time order: filters, differences, rolling and running measures.

Filters come before windows: a row-count window advances on usable rows only. Windows of up to
SLIDING rows use a sliding frame; longer ones are differences of prefix sums, O(n) for any length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeline.functions.stats import SUMS, correlation, sums
from tapeline.operators.scratch import released, stored

KEY = ("day", "product")
SLIDING = 64
#: Rows of a block, and the time in which about as many stand (a tick is 100).
LENGTH, SPAN = 4096, 409_600


def in_order(keys: tuple[str, ...] = KEY, order: str = "timestamp") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def mid_series(prices: DataFrame, product: str) -> DataFrame:
    """One product's mids; the filter reaches the scan."""
    return prices.filter(F.col("product") == product).select("day", "timestamp", "mid_price")


def clean_mids(prices: DataFrame) -> DataFrame:
    """Without gap ticks (no mid, or a mid of 0)."""
    return prices.filter(F.col("mid_price") > 0)


def first_difference(df: DataFrame, value: str, out: str = "change", keys: tuple[str, ...] = KEY, order: str = "timestamp") -> DataFrame:
    """value less the one before in the same key; a key's first row goes."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(in_order(keys, order))).filter(F.col(out).isNotNull())


def every(df: DataFrame, k: int, keys: tuple[str, ...] = KEY, order: str = "timestamp") -> DataFrame:
    """Rows 0, k, 2k, ... of each key."""
    if k == 1:
        return df
    return df.withColumn("_row", F.row_number().over(in_order(keys, order)) - 1).filter(F.col("_row") % k == 0).drop("_row")


def rolling(df: DataFrame, value: str, window: int, keys: tuple[str, ...] = KEY, order: str = "timestamp", sliding: int = SLIDING) -> DataFrame:
    """Adds roll_n, roll_mean and roll_std (population, null below two) of the values in the last `window` rows.

    Null values take a row's place in the window and count for nothing else, whatever the window's length.
    """
    if window < 2:
        raise ValueError("a window has two rows at least")
    w, x = in_order(keys, order), F.col(value)
    if window <= sliding:
        frame = w.rowsBetween(1 - window, 0)
        out = df.withColumn("roll_n", F.count(x).over(frame)).withColumn("roll_mean", F.avg(x).over(frame))
        return out.withColumn("roll_std", F.when(F.col("roll_n") >= 2, F.stddev_pop(x).over(frame)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    # centred on the key's first value, which keeps the sums small
    out = df.withColumn("_f", F.first(x, ignorenulls=True).over(upto)).withColumn("_c", x - F.col("_f")).withColumn("_k", F.count(x).over(upto))
    out = out.withColumn("_s", F.coalesce(F.sum("_c").over(upto), zero)).withColumn("_q", F.coalesce(F.sum(F.col("_c") * F.col("_c")).over(upto), zero))
    # a window of equal values has no variance, whatever its sums have rounded to: which value the run began with
    former = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_turn", F.when(x.isNotNull() & ~x.eqNullSafe(former), F.col("_k")))
    out = out.withColumn("_since", F.max("_turn").over(upto))
    gone = lambda c, none: F.col(c) - F.coalesce(F.lag(c, window).over(w), none)
    out = out.withColumn("roll_n", gone("_k", F.lit(0)).cast("long")).withColumn("_ws", gone("_s", zero)).withColumn("_wq", gone("_q", zero))
    n = F.when(F.col("roll_n") > 0, F.col("roll_n").cast("double"))
    mean = F.col("_ws") / n
    var = F.when(F.col("_since") <= F.col("_k") - n + 1, zero).otherwise(F.greatest(zero, F.col("_wq") / n - mean * mean))
    out = out.withColumn("roll_mean", F.col("_f") + mean).withColumn("roll_std", F.when(n >= 2, F.sqrt(var)))
    return out.drop("_f", "_c", "_k", "_s", "_q", "_turn", "_since", "_ws", "_wq")


def in_blocks(df: DataFrame, measure: Callable[[DataFrame, tuple[str, ...]], DataFrame], window: int, length: int = LENGTH, span: int = SPAN, keys: tuple[str, ...] = KEY, order: str = "timestamp") -> DataFrame:
    """measure(rows, keys) for series too long for one task, in blocks of `length` rows of a key.

    A block also gets the window - 1 rows before it, so any measure of the last `window` rows is the
    same as over the whole series. Row numbers come from counts per time span and ranks inside one:
    no task sorts a whole key. The order has no ties; length is at least the window. df is made once and stored, since
    it is counted before it is cut.
    """
    if length < window:
        raise ValueError("a block holds a window at least")
    rows = stored(df, "series").withColumn("_span", F.floor(F.col(order) / span))
    upto = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    counts = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, "_span", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order))
    rows = rows.withColumn("_rank", rank).join(counts, [*keys, "_span"]).withColumn("_row", F.col("_before") + F.col("_rank") - 1)
    own = F.floor(F.col("_row") / length)
    blocks = F.when(F.col("_row") % length > length - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select(*df.columns, own.alias("_own"), F.explode(blocks).alias("_block"))
    return measure(rows, (*keys, "_block")).filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def before(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = KEY, order: str = "timestamp", span: int = SPAN) -> DataFrame:
    """Adds out: the value of the row before in the same key, in blocks."""
    return in_blocks(df, lambda rows, k: rows.withColumn(out, F.lag(value).over(in_order(k, order))), 2, span=span, keys=keys, order=order)


def zscore(df: DataFrame, value: str, window: int, keys: tuple[str, ...] = KEY, order: str = "timestamp") -> DataFrame:
    """Adds z (null until the window is full or without variance) to rolling()."""
    ready = (F.col("roll_n") == window) & (F.col("roll_std") > 0)
    return rolling(df, value, window, keys, order).withColumn("z", F.when(ready, (F.col(value) - F.col("roll_mean")) / F.col("roll_std")))


def zscores(df: DataFrame, value: str, window: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """zscore() in blocks."""
    return in_blocks(df, lambda rows, k: zscore(rows, value, window, k), window, max(LENGTH, window), keys=keys)


def causal_regime(prices: DataFrame, window: int = 200) -> DataFrame:
    """day, product, timestamp, mid_price, z, std of the ticks whose regime is known."""
    return zscores(clean_mids(prices), "mid_price", window).filter(F.col("z").isNotNull()).select(*KEY, "timestamp", "mid_price", "z", F.col("roll_std").alias("std"))


def ema(df: DataFrame, value: str, span: float, keys: tuple[str, ...] = KEY, order: str = "timestamp", block: int = 100_000) -> DataFrame:
    """Adds ema: alpha = 2 / (span + 1), seeded with the key's first value. value has no nulls.

    A series is smoothed in blocks of `block` units of time, each as if it began there. What the blocks
    before add is their end times the decay since: ends are composed over one row a block.
    """
    if span <= 1:
        raise ValueError("span is over 1")
    alpha = 2 / (span + 1)
    own = df.select(*keys, order, value, F.floor(F.col(order) / block).alias("_block"))
    parts = [*keys, "_block"]

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        decay = (1 - alpha) ** np.arange(1, len(rows) + 1)
        return rows.assign(_local=rows[value].ewm(alpha=alpha, adjust=False).mean(), _decay=decay, _first=rows[value].iloc[0])

    def carry(ends: pd.DataFrame) -> pd.DataFrame:
        ends, before = ends.sort_values("_block"), []
        for first, local, decay in zip(ends["_first"], ends["_end"], ends["_decay"]):
            before.append(first if not before else last)
            last = local + decay * before[-1]
        return ends.assign(_carry=before)[[*parts, "_carry"]]

    typed = lambda frame, names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in names)
    after = F.row_number().over(Window.partitionBy(*parts).orderBy(F.col(order).desc())) - 1
    weighed = own.withColumn("_w", F.pow(F.lit(1 - alpha), after)).groupBy(*parts).agg(
        F.min_by(value, order).cast("double").alias("_first"), F.sum(alpha * F.col(value) * F.col("_w")).alias("_end"),
        F.pow(F.lit(1 - alpha), F.count("*")).alias("_decay"),
    )
    carries = weighed.groupBy(*keys).applyInPandas(carry, f"{typed(weighed, parts)}, _carry double")
    local = own.groupBy(*parts).applyInPandas(smooth, f"{typed(own, own.columns)}, _local double, _decay double, _first double")
    return local.join(carries, parts).select(*keys, order, value, (F.col("_local") + F.col("_decay") * (F.col("_carry") - F.col("_first"))).alias("ema"))


def lag_acf(df: DataFrame, value: str, window: int, lag: int, keys: tuple[str, ...] = KEY, order: str = "timestamp", sliding: int = SLIDING) -> DataFrame:
    """Adds acf: the correlation of the last `window` pairs (x now, x `lag` rows ago). A row depends on
    the window + lag rows up to it, so in_blocks() serves long series."""
    w = in_order(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    centred = df.withColumn("_x", F.col(value) - F.first(value).over(upto))
    paired, names = centred.withColumn("_y", F.lag("_x", lag).over(w)), [f"_{k}" for k in SUMS]
    frame = w.rowsBetween(1 - window, 0) if window <= sliding else upto
    totals = paired.select("*", *[c.alias(k) for c, k in zip(sums(F.col("_x"), F.col("_y"), over=frame), names)])
    if window > sliding:
        gone = [(F.col(k) - F.coalesce(F.lag(k, window).over(w), F.lit(0.0))).alias(k) for k in names]
        totals = totals.select(*df.columns, *gone)
    return totals.withColumn("acf", correlation(None, prefix="_")).select(*df.columns, "acf")


def drift_monitor(df: DataFrame, value: str, window: int, threshold: float, keys: tuple[str, ...] = KEY, order: str = "timestamp", span: int = SPAN) -> DataFrame:
    """Adds drifting: the rolling mean is over `threshold` away from the mean of the first full window."""
    rolled = in_blocks(df, lambda rows, k: rolling(rows, value, window, k, order), window, max(LENGTH, window), span, keys, order)
    full = F.col("roll_n") == window
    frozen = rolled.filter(full).groupBy(*keys).agg(F.min_by("roll_mean", order).alias("_frozen"))
    out = rolled.join(frozen, list(keys), "left").withColumn("reference", F.when(full, F.col("_frozen"))).drop("_frozen")
    return out.withColumn("drifting", F.coalesce(full & (F.abs(F.col("roll_mean") - F.col("reference")) > threshold), F.lit(False)))


def drifting_fraction(df: DataFrame, value: str, window: int, threshold: float, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Share of drifting rows among those with a full window."""
    full = drift_monitor(df, value, window, threshold, keys).filter(F.col("roll_n") == window)
    return full.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("drifting").cast("double")).alias("fraction"))


def drawdown(df: DataFrame, value: str, keys: tuple[str, ...] = KEY, order: str = "timestamp", span: int = SPAN) -> DataFrame:
    """Per key: the largest fall below the running maximum. A span of time has its own falls, and those
    of its least value below the maximum of all spans before."""
    rows = df.withColumn("_span", F.floor(F.col(order) / span))
    top = F.max(value).over(in_order((*keys, "_span"), order).rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumn("_fall", top - F.col(value)).groupBy(*keys, "_span").agg(F.max("_fall").alias("_fall"), F.max(value).alias("_top"), F.min(value).alias("_low"))
    earlier = F.max("_top").over(in_order(keys, "_span").rowsBetween(Window.unboundedPreceding, -1))
    fall = F.greatest("_fall", earlier - F.col("_low"), F.lit(0.0))
    return spans.select(*keys, fall.alias("_fall")).groupBy(*keys).agg(F.max("_fall").alias("max_drawdown"))


def sharpe(df: DataFrame, value: str, keys: tuple[str, ...] = KEY, order: str = "timestamp", span: int = SPAN) -> DataFrame:
    """Per key: mean over population deviation of the steps; null below three points or without variance."""
    steps = before(df, value, "_p", keys, order, span).withColumn("_d", F.col(value) - F.col("_p"))
    agg = steps.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"))
    return agg.select(*keys, F.when((F.col("_n") >= 3) & (F.col("_s") > 0), F.try_divide("_m", "_s")).alias("sharpe"))


def start_anchor(df: DataFrame, value: str, slope: float, limit: float, keys: tuple[str, ...] = KEY, order: str = "timestamp") -> DataFrame:
    """Adds fair (the first value plus slope times the time since) and halted: once the value is over
    `limit` away from fair, the key stays halted. Keys are not null.

    No row is sorted: a key's first row and the earliest time at which it strays are two aggregations, over a stored
    table of the times and values.
    """
    rows = stored(df.select(*keys, order, value), "anchored")
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(order).alias("t")), F.col(order)).alias("_first"))

    def fair(frame: DataFrame) -> DataFrame:
        return frame.withColumn("fair", F.col("_first.v") + F.lit(slope) * (F.col(order) - F.col("_first.t")))

    trips = fair(rows.join(first, list(keys))).filter(F.abs(F.col(value) - F.col("fair")) > limit).groupBy(*keys).agg(F.min(order).alias("_trip"))
    known = stored(first.join(trips, list(keys), "left"), "anchors")  # a row a key
    released(rows)
    return fair(df.join(known, list(keys))).withColumn("halted", F.coalesce(F.col(order) >= F.col("_trip"), F.lit(False))).drop("_first", "_trip")


def family_totals(prices: DataFrame, family: str = "family") -> DataFrame:
    """Adds total (of the family at the tick) and others (total less the own mid)."""
    whole = F.sum("mid_price").over(Window.partitionBy("day", "timestamp", family))
    return prices.withColumn("total", whole).withColumn("others", F.col("total") - F.col("mid_price"))


def percentiles(value: Column, at: list[float], accuracy: int | None = None) -> Column:
    """Array of linear-interpolation percentiles; approximate ones if accuracy is given."""
    points = F.array(*[F.lit(float(p)) for p in at])
    return F.percentile(value, points) if accuracy is None else F.percentile_approx(value, points, accuracy)
