"""Statistics from additive sums, as Column expressions.

A sums struct holds n, sx, sy, sxx, syy, sxy. Sums of parts (days, replicates, halves of a window)
add up to the sums of the whole, so one partial aggregation serves pooled, per-day and resampled fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A variance below this share of its sum of squares is the residue of cancellation: zero.
RESIDUE = 1e-12
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def sums(x: Column, y: Column, where: Column | None = None, over=None) -> list[Column]:
    """The six sums over rows where both are present (and `where` holds), as named columns."""
    ok = x.isNotNull() & y.isNotNull()
    ok = ok if where is None else ok & where
    parts = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    out = []
    for name in SUMS:
        total = F.sum(F.when(ok, parts[name]).otherwise(F.lit(0.0)))
        total = total if over is None else total.over(over)
        out.append(F.coalesce(total, F.lit(0.0)).alias(name))
    return out


def merged(names: tuple[str, ...] = SUMS) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def moments(x: Column, y: Column) -> list[Column]:
    """n, means and centred sums of squares and products over rows where both are present, as named columns of one
    aggregation; Spark centres them as it goes."""
    a, b = (F.when(x.isNotNull() & y.isNotNull(), c.cast("double")) for c in (x, y))
    zero = F.lit(0.0)
    centred = [F.coalesce(f(b, a), zero).alias(name) for f, name in ((F.regr_sxx, "cxx"), (F.regr_syy, "cyy"), (F.regr_sxy, "cxy"))]
    return [F.regr_count(b, a).cast("double").alias("n"), F.coalesce(F.avg(a), zero).alias("mx"), F.coalesce(F.avg(b), zero).alias("my"), *centred]


def about_mean(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of moments() of parts (days) about the mean of all parts of their key, which they share: they add up to
    those of the whole. Also the means, _mx and _my. What only rounding leaves of a variance is 0."""
    whole = Window.partitionBy(*keys)  # a row a part
    total = F.sum("n").over(whole)
    rows = parts.withColumn("_mx", F.try_divide(F.sum(F.col("n") * F.col("mx")).over(whole), total)).withColumn("_my", F.try_divide(F.sum(F.col("n") * F.col("my")).over(whole), total))
    n, dx, dy = F.col("n"), F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    rows = rows.withColumns({"sx": n * dx, "sy": n * dy, "sxx": F.col("cxx") + n * dx * dx, "syy": F.col("cyy") + n * dy * dy, "sxy": F.col("cxy") + n * dx * dy})
    still = lambda square, mean: F.sum(square).over(whole) <= total * F.pow(F.abs(mean) * RESIDUE, F.lit(2.0))
    rows = rows.withColumn("_x0", still("sxx", F.col("_mx"))).withColumn("_y0", still("syy", F.col("_my")))
    gone = {"sx": "_x0", "sxx": "_x0", "sy": "_y0", "syy": "_y0"}
    rows = rows.withColumns({c: F.when(F.col(flag), F.lit(0.0)).otherwise(F.col(c)) for c, flag in gone.items()})
    rows = rows.withColumn("sxy", F.when(F.col("_x0") | F.col("_y0"), F.lit(0.0)).otherwise(F.col("sxy")))
    return rows.drop("mx", "my", "cxx", "cyy", "cxy", "_x0", "_y0")


def _moments(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    n, sx, sy, sxx, syy, sxy = (F.col(f"{prefix}{k}") for k in SUMS)
    return n, n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy


def _flat(spread: Column, n: Column, square: Column) -> Column:
    return spread <= RESIDUE * n * square


def correlation(degenerate: float | None = None, prefix: str = "", least: int = 2) -> Column:
    """Pearson correlation, clamped to [-1, 1]; `degenerate` for under `least` pairs or no variance."""
    n, vx, vy, cov = _moments(prefix)
    flat = _flat(vx, n, F.col(f"{prefix}sxx")) | _flat(vy, n, F.col(f"{prefix}syy")) | (n < least)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))))
    return F.when(flat, F.lit(degenerate).cast("double")).otherwise(value)


def line(prefix: str = "") -> tuple[Column, Column, Column]:
    """Slope, intercept and R2 of y on x: (0, mean of y, 0) without variance of x, zeros below two
    points, R2 0 for a constant y and never outside of [0, 1]."""
    n, vx, vy, cov = _moments(prefix)
    sx, sy, sxx, syy = (F.col(f"{prefix}{k}") for k in ("sx", "sy", "sxx", "syy"))
    flat = _flat(vx, n, sxx)
    slope = F.when((n < 2) | flat, F.lit(0.0)).otherwise(F.try_divide(cov, vx))
    intercept = F.when(n < 2, F.lit(0.0)).when(flat, F.try_divide(sy, n)).otherwise(F.try_divide(sy - slope * sx, n))
    r2 = F.when((n < 2) | flat | _flat(vy, n, syy), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.try_divide(cov * cov, vx * vy))
    )
    return slope, intercept, r2


def bracket(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))
