"""Big moves, their closeness to a price grid, and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.sizing import grid_distance
from tapeline.functions.stats import SUMS, correlation, merged, sums
from tapeline.operators.bootstrap import oriented_p, unit_draws
from tapeline.operators.flow import bucket_edges, bucket_of
from tapeline.operators.series import KEY, LENGTH, clean_mids, first_difference, in_blocks, in_order, rolling

LABELS = ("low", "middle", "high")


def flagged(prices: DataFrame, window: int = 200, sigmas: float = 3.0, modulus: float = 100.0, tolerance: float = 2.0, exclude_zero_multiple: bool = False) -> DataFrame:
    """Changes of clean mids with big and grid: a move of `sigmas` deviations of the changes so far or
    more, and one that is near a multiple of the modulus (0 included, unless excluded); and the change before
    with its own flags (prior). In blocks of a series."""
    near = grid_distance(F.col("change"), modulus) <= tolerance
    if exclude_zero_multiple:
        near = near & (F.abs("change") > tolerance)

    def measure(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        d = rolling(first_difference(rows, "mid_price", keys=keys), "change", window, keys)
        big = (F.col("roll_n") == window) & (F.col("roll_std") > 0) & (F.abs("change") >= sigmas * F.col("roll_std"))
        d = d.withColumn("big", F.coalesce(big, F.lit(False))).withColumn("grid", F.col("big") & near)
        return d.withColumn("prior", F.lag(F.struct("timestamp", "change", "big", "grid")).over(in_order(keys)))

    # a change needs two mids, the change before its own window
    reach = window + 2
    return in_blocks(clean_mids(prices), measure, reach, max(LENGTH, reach))


def pair_sums(jumps: DataFrame) -> DataFrame:
    """product, day, kind and the sums of (change, next change): all pairs, those whose first is a grid
    move, and those whose first is another big move (control)."""
    kinds = F.array(
        F.lit("all"), F.when(F.col("prior.grid"), "grid"), F.when(F.col("prior.big") & ~F.col("prior.grid"), "control")
    )
    rows = jumps.filter(F.col("prior").isNotNull()).select("product", "day", "prior", "change", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return rows.groupBy("product", "day", "kind").agg(*sums(F.col("prior.change"), F.col("change")))


def _wide(stats: DataFrame, keys: list[str]) -> DataFrame:
    """corr and n of each kind side by side."""
    got = stats.groupBy(*keys, "kind").agg(*merged()).select(*keys, "kind", "n", correlation(None).alias("corr"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return got.groupBy(*keys).agg(*[pick(k, "corr").alias(f"{k}_acf") for k in ("all", "grid", "control")], *[F.coalesce(pick(k, "n"), F.lit(0)).cast("long").alias(f"n_{k}") for k in ("grid", "control")])


def conditional_acf(stats: DataFrame, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """Per product: the three lag-1 correlations, counts, grid less control with the interval and p of
    resampled days. An undefined difference has nulls; an undefined replicate counts as 0."""
    whole = _wide(stats, ["product"]).withColumn("diff", F.col("grid_acf") - F.col("control_acf"))
    draws = unit_draws(stats.select("day").distinct(), "day", replicates, seed)
    again = draws.join(stats, "day").groupBy("product", "replicate", "kind").agg(*merged(SUMS))
    again = _wide(again, ["product", "replicate"]).select("product", "replicate", F.coalesce(F.col("grid_acf") - F.col("control_acf"), F.lit(0.0)).alias("again"))
    full = whole.filter("diff IS NOT NULL").select("product", "diff").join(again, "product")
    return whole.join(oriented_p(F.col("diff"), "again", ["product"], replicates, full), "product", "left")


def grid_control_counts(stats: DataFrame) -> DataFrame:
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0.0)).cast("long")
    return stats.groupBy("product", "day").agg(pick("grid").alias("n_grid"), pick("control").alias("n_control"))


def grid_records(jumps: DataFrame, spreads: DataFrame) -> DataFrame:
    """product, day, amplitude, spread, reversal of each grid move with a spread and a next change.

    spreads: day, product, timestamp, spread at the tick of the move; missing and non-positive ones drop.
    """
    first, then = F.col("prior.change"), F.col("change")
    rows = jumps.filter("prior.grid").select("product", "day", F.col("prior.timestamp").alias("timestamp"), F.abs(first).alias("amplitude"), (-F.signum(first) * then).alias("reversal"))
    rows = rows.join(spreads.select(*KEY, "timestamp", "spread"), [*KEY, "timestamp"]).filter("spread > 0")
    return rows.select("product", "day", "amplitude", "spread", "reversal")


def amplitude_buckets(records: DataFrame) -> DataFrame:
    """Per product and pooled tertile of amplitude over spread: n and means; empty ones are left out."""
    ratio = F.col("amplitude") / F.col("spread")
    rows = records.crossJoin(F.broadcast(bucket_edges(ratio, records)))  # one row
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), bucket_of(ratio, F.col("edges")))
    return rows.groupBy("product", label.alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("amplitude").alias("mean_amplitude"), F.avg("spread").alias("mean_spread"), F.avg("reversal").alias("mean_reversal")
    )
