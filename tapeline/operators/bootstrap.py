"""Bootstraps on additive statistics.

Random draws are a pure function of (seed, replicate, slot), so any engine, rerun or lost executor
gets the same resamples. Replicates combine statistics of units (days, blocks), never the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import SUMS, merged
from tapeline.operators.series import LENGTH, SPAN


#: Values of r2 that are this close are equal.
TIE = 1e-9
#: Tasks that make the draws of blocks: few rows become very many, which Spark can't foresee.
DRAWING = 96


def draw(seed: int, replicate: Column, slot: Column, n: Column | int) -> Column:
    """A number from 0 to n - 1: the first 32 bits of an MD5, modulo n."""
    n = F.lit(n) if isinstance(n, int) else n
    key = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n.cast("long"))


def unit_draws(units: DataFrame, unit: str, replicates: int, seed: int, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, replicate, unit) rows: as many units as there are in each group, drawn from its own with replacement.
    units: distinct (*within, unit) rows."""
    ranked = units.select(*within, unit, (F.row_number().over(Window.partitionBy(*within).orderBy(unit)) - 1).alias("_k"))  # a few days
    sizes = units.groupBy(*within).agg(F.count("*").alias("_n"))
    slots = ranked.select(*within, F.col("_k").alias("slot"))
    slots = slots.join(sizes, list(within)) if within else slots.crossJoin(F.broadcast(sizes))  # one row
    reps = units.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    drawn = reps.crossJoin(slots).withColumn("_k", draw(seed, F.col("replicate"), F.col("slot"), F.col("_n")))
    return drawn.join(ranked, [*within, "_k"]).select(*within, "replicate", unit)


#: P(weight <= k) of a Poisson weight with mean 1, up to where 32 bits can't tell it from 1.
POISSON = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def poisson_weights(seed: int, key: Column, replicates: int) -> Column:
    """A row's weights in all replicates: how often a resample of a large sample takes it. Replicate r has 32 bits of an
    MD5 over (seed, key, r div 4), so each digest serves four replicates."""
    def four(k: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, k.cast("string")))
        return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / float(1 << 32) for i in range(4)])

    units = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)), four)), 1, replicates)
    return F.transform(units, lambda u: F.size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: p <= u)))


def resampled_sums(stats: DataFrame, unit: str, keys: list[str], draws: DataFrame, names: tuple[str, ...] = SUMS) -> DataFrame:
    """Sums per (keys, replicate) over the drawn units. stats: one row per (keys, unit)."""
    return draws.join(stats, unit).groupBy(*keys, "replicate").agg(*merged(names))


def oriented_p(estimate: Column, replicate_value: str, keys: list[str], replicates: int, frame: DataFrame) -> DataFrame:
    """Per key: ci_low, ci_high (2.5 and 97.5 %), p and floored.

    The one-sided share of replicates on the other side of zero than the estimate (zero included);
    no such replicate gives 1 / (replicates + 1) with floored set.
    """
    v = F.col(replicate_value)
    exceed = F.when(estimate >= 0, v <= 0).otherwise(v >= 0)
    agg = frame.groupBy(*keys).agg(
        F.percentile(v, F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"), F.sum(exceed.cast("long")).alias("_exceed")
    )
    p = F.when(F.col("_exceed") == 0, F.lit(1.0 / (replicates + 1))).otherwise(F.col("_exceed") / F.lit(float(replicates)))
    return agg.select(
        *keys, F.get("_ci", F.lit(0)).alias("ci_low"), F.get("_ci", F.lit(1)).alias("ci_high"), p.alias("p"), (F.col("_exceed") == 0).alias("floored")
    )


def block_sums(df: DataFrame, value: str, keys: list[str], order: str, length: int, span: int = SPAN, part: int = LENGTH) -> DataFrame:
    """For each circular block start s of each key: n, and for the full and the truncated last block the sums of y
    (less the key's first value), y*y and local index * y.

    Rows are numbered by counts per time span and ranks inside one; prefix sums run in parts of `part` rows, each with
    the `length` rows after it. The series begins again at its end, by its first rows only. Keys are not null.
    """
    rows = df.select(*keys, F.col(order).alias("_t"), F.col(value).alias("y"), F.floor(F.col(order) / span).alias("_span"))
    counts = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n"), F.min_by("y", "_t").alias("_y"))
    whole = Window.partitionBy(*keys).orderBy("_span")  # a row a span
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select(
        *keys, "_span", F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(every).alias("n"), F.first("_y").over(every).alias("_first"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("_t")) - 1
    rows = rows.withColumn("_r", rank).join(counts, [*keys, "_span"])
    rows = rows.select(*keys, "n", (F.col("y") - F.col("_first")).alias("y"), (F.col("_before") + F.col("_r")).alias("i"))
    # row i once more at i + n if a block that began before the end reaches it; blocks are never longer than the series
    size = F.least(F.lit(length), F.col("n"))
    again = F.when(F.col("i") < size, F.array("i", F.col("i") + F.col("n"))).otherwise(F.array("i"))
    twice = rows.select(*keys, "n", "y", F.explode(again).alias("j"))
    own = F.floor(F.col("j") / part)
    parts = F.when((F.col("j") % part < length) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    twice = twice.select("*", own.alias("_own"), F.explode(parts).alias("_part")).withColumn("_local", F.col("j") - F.col("_part") * part)
    upto = Window.partitionBy(*keys, "_part").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    y = F.col("y")
    twice = twice.select("*", F.sum(y).over(upto).alias("p1"), F.sum(y * y).over(upto).alias("p2"), F.sum(F.col("_local") * y).over(upto).alias("pj"))
    blocks = F.ceil(F.col("n") / F.lit(length))
    tail = F.col("n") - (blocks - 1) * length
    starts = twice.filter("_own = _part AND j < n").select(
        *keys, "_part", "n", F.col("j").alias("s"), "_local", (F.col("j") + F.least(F.lit(length), F.col("n")) - 1).alias("_full"), (F.col("j") + tail - 1).alias("_last"),
        (F.col("p1") - y).alias("b1"), (F.col("p2") - y * y).alias("b2"), (F.col("pj") - F.col("_local") * y).alias("bj"),
    )
    for name in ("full", "last"):
        ends = twice.select(*keys, "_part", F.col("j").alias(f"_{name}"), *[F.col(f"p{k}").alias(f"{name}{k}") for k in "12j"])
        starts = starts.join(ends, [*keys, "_part", f"_{name}"])
        starts = starts.withColumns({f"{name}{k}": F.col(f"{name}{k}") - F.col(f"b{k}") for k in "12j"})
        starts = starts.withColumn(f"{name}j", F.col(f"{name}j") - F.col("_local") * F.col(f"{name}1"))
    return starts.select(*keys, "n", "s", *[f"{name}{k}" for name in ("full", "last") for k in "12j"])


def block_draws(sizes: DataFrame, keys: list[str], length: int, replicates: int, seed: int) -> DataFrame:
    """(*keys, n, m, replicate, b, s): block b of a replicate begins at s; replicate -1 is the series itself. sizes: keys, n,
    and m, the blocks of a replicate. Replicates are dealt by a number of tasks: by their few bytes Spark would
    make all draws in one."""
    reps = sizes.sparkSession.range(-1, replicates).select(F.col("id").alias("replicate"))
    plan = sizes.crossJoin(reps).repartition(DRAWING)
    plan = plan.select(*keys, "n", "m", "replicate", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("b"))
    start = F.when(F.col("replicate") < 0, F.col("b") * length).otherwise(draw(seed, F.col("replicate"), F.col("b"), F.col("n")))
    return plan.withColumn("s", start.cast("int"))


def block_bootstrap_trend(df: DataFrame, value: str, keys: list[str], order: str, length: int, replicates: int, seed: int) -> DataFrame:
    """Per key: n, r2 of a linear trend, and its p-value (exceed + 1) / (replicates + 1) among circular
    block resamples. A replicate is ceil(n / length) lookups of block sums. A resample that is the series itself
    exceeds it, whatever rounding leaves (TIE). Constant series: null p."""
    blocks = block_sums(df, value, keys, order, length)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("m", F.ceil(F.col("n") / F.lit(length)).cast("int"))
    plan = block_draws(sizes, keys, length, replicates, seed)
    last = F.col("b") == F.col("m") - 1
    pick = lambda tag: F.when(last, F.col(f"last{tag}")).otherwise(F.col(f"full{tag}"))
    rows = plan.hint("merge").join(blocks.drop("n"), [*keys, "s"])  # by the bytes before the draws Spark would broadcast them
    sums = rows.groupBy(*keys, "n", "replicate").agg(
        F.sum(pick("1")).alias("sy"), F.sum(pick("2")).alias("syy"), F.sum(F.col("b") * length * pick("1") + pick("j")).alias("sxy")
    )
    n = F.col("n").cast("double")
    vx = n * n * (n * n - 1) / 12
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - n * (n - 1) / 2 * F.col("sy")
    r2 = F.when(vy > 1e-12 * n * F.col("syy"), F.least(F.lit(1.0), F.try_divide(cov * cov, vx * vy)))
    sums = sums.withColumn("r2", r2)
    own = sums.filter("replicate < 0").select(*keys, "n", F.col("r2").alias("own"))
    joined = sums.filter("replicate >= 0").select(*keys, F.coalesce("r2", F.lit(0.0)).alias("r2")).join(own, keys)
    p = (F.sum((F.col("r2") >= F.col("own") - TIE).cast("long")) + 1) / F.lit(float(replicates + 1))
    return joined.groupBy(*keys).agg(F.first("n").alias("n"), F.first("own").alias("r2"), F.when(F.first("own").isNotNull(), p).alias("p"))
