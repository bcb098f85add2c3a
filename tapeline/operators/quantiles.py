"""Exact quantiles of any number of rows by selection in passes: nothing is sorted but a few rows.

Values are counted in cells: a key's first by sign and binary exponent, then each cell that holds a wanted rank is cut into
PARTS equal parts, and so on. Every pass is one additive aggregation with a row for each cell. It ends where a
wanted cell (to begin with, the key) holds one value, or no more than SMALL rows; those are ranked. A set that leaves one day out has
the counts of all days less that day's, so no row is ever copied for another day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.scratch import released, stored

#: Parts that a cell is cut into; most rows of a cell that are ranked.
PARTS, SMALL = 4096, 200_000


def _exponent_cell(x: Column) -> Column:
    """Sign and binary exponent as one number that grows with x; NaN stands above all."""
    exponent = F.greatest(F.lit(-1080.0), F.least(F.lit(1100.0), F.floor(F.log2(F.abs(x))).cast("double")))
    cell = F.when(x == 0, F.lit(0.0)).when(F.isnan(x), F.lit(4000.0)).otherwise(F.signum(x) * (2000 + exponent))
    return cell.cast("long")


def _part(x: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that x lies in; grows with x."""
    inner = F.floor(F.try_divide(x / 2 - low / 2, high / 2 - low / 2) * PARTS)
    return F.when(x <= low, 0).when(x >= high, PARTS - 1).otherwise(F.least(F.lit(PARTS - 1), inner)).cast("long")


def _counted(values: DataFrame, keys: list[str], day: str | None) -> DataFrame:
    days = [day] if day else []
    return values.groupBy(*keys, "cell", "part", *days).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def _located(targets: DataFrame, counts: DataFrame, keys: list[str], day: str | None) -> DataFrame:
    """targets (keys, [held_out], cell, rank in the cell) with the part that holds the rank, its bounds and
    rows, and the rank in it."""
    cell = [*keys, "cell"]
    bounds = counts.groupBy(*cell, "part").agg(F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    view = cell
    if day:
        # a held-out day's counts are taken from those of all days
        held = targets.select(*cell, "held_out").distinct()
        own = counts.select(*cell, "part", F.col(day).alias("held_out"), F.col("n").alias("gone"))
        seen = bounds.join(held, cell).join(own, [*cell, "part", "held_out"], "left").withColumn("n", F.col("rows") - F.coalesce("gone", F.lit(0))).drop("gone")
        view = [*cell, "held_out"]
    else:
        seen = bounds.withColumn("n", F.col("rows"))
    upto = Window.partitionBy(*view).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row a part
    seen = seen.withColumn("_after", F.sum("n").over(upto)).withColumn("_before", F.col("_after") - F.col("n"))
    met = targets.join(seen, view).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_after")))
    return met.withColumn("rank", F.col("rank") - F.col("_before")).drop("_before", "_after", "n")


def quantiles(df: DataFrame, value: Column, at: Sequence[float], keys: Sequence[str] = (), leave_out: str | None = None) -> DataFrame:
    """keys, [held_out], n, p: the quantiles `at` of value by linear interpolation, as Spark's percentile.

    leave_out: a column; then there is a row for each of its values held_out in df (also for those in which a key
    has no rows): the quantiles of all rows of the key but those. Null values are left out; keys (or what is left of them) without
    values have no row, but without keys there is one row, with nulls if nothing is left. Null keys are keys.
    """
    keys, days = list(keys), [leave_out] if leave_out else []
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    # keys as text that is never null, so that they can be joined
    made = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(n) for k, n in zip(keys, names)] or [F.lit("").alias("_k0")]
    kept = stored(df.select(*made, *[F.col(k).alias(f"_v{i}") for i, k in enumerate(keys)], *[F.col(d).alias("_day") for d in days], value.cast("double").alias("x")), "values")
    day = "_day" if leave_out else None
    values = kept.filter("x IS NOT NULL").withColumn("cell", F.lit("")).withColumn("part", _exponent_cell(F.col("x")))
    sizes = stored(values.groupBy(*names, *days and ["_day"]).agg(F.count("*").alias("n")), "sizes")
    tables = [kept, sizes]

    groups = sizes.groupBy(*names).agg(F.sum("n").alias("n"))
    most = groups.agg(F.max("n")).first()[0] or 0
    view = names
    if leave_out:
        own = sizes.select(*names, F.col("_day").alias("held_out"), F.col("n").alias("gone"))
        held = kept.select(F.col("_day").alias("held_out")).distinct()
        groups = groups.crossJoin(held).join(own, [*names, "held_out"], "left")  # a row a key and day
        groups = groups.withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone").filter("n > 0")
        view = [*names, "held_out"]
    # the two rows around each quantile
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for i, p in enumerate(at)]))
    wanted = groups.select(*view, "n", pairs.alias("q")).select(*view, "n", "q.*")
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("want"))
    open_ = wanted.select(*view, F.col("want").cast("long").alias("want")).distinct().withColumn("rank", F.col("want")).withColumn("cell", F.lit(""))
    inside, found = values, None
    while most > SMALL:
        counts = stored(_counted(values, names, day), "cells")
        targets = stored(_located(open_, counts, names, day), "ranks")
        tables += [counts, targets]
        single = F.col("low") == F.col("high")
        done = targets.filter(single).select(*view, "want", F.col("low").alias("x"))
        found = done if found is None else found.unionByName(done)
        open_ = targets.filter(~single)
        most = open_.agg(F.max("rows")).first()[0] or 0
        cells = open_.select(*names, F.col("cell").alias("_c"), F.col("part").alias("_p"), "low", "high").distinct()
        # rows of the open cells
        inside = values.join(cells, [*[values[n] == cells[n] for n in names], values["cell"] == cells["_c"], values["part"] == cells["_p"]])
        inside = inside.select(*[values[n] for n in names], *days and ["_day"], "x", F.concat_ws("/", values["cell"], values["part"]).alias("cell"), "low", "high")
        values = inside.withColumn("part", _part(F.col("x"), F.col("low"), F.col("high"))).drop("low", "high")
        open_ = open_.select(*view, "want", "rank", F.concat_ws("/", "cell", "part").alias("cell"))
    if most:
        if leave_out:
            ends = open_.select(*names, "cell", "held_out").distinct()
            inside = inside.join(ends, [*names, "cell"]).filter(~F.col("_day").eqNullSafe(F.col("held_out")))
        ranks = inside.withColumn("rank", F.row_number().over(Window.partitionBy(*view, "cell").orderBy("x")) - 1)
        ranks = ranks.join(open_, [*view, "cell", "rank"]).select(*view, "want", "x")
        found = ranks if found is None else found.unionByName(ranks)
    elif found is None:
        found = open_.select(*view, "want", F.lit(None).cast("double").alias("x"))
    both = wanted.join(found, [*view, "want"]).groupBy(*view, "n", "i", "place").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # equal neighbours stay as they are; others are mixed by their distances
    share = F.col("place") - F.floor("place")
    mixed = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    rows = both.groupBy(*view, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", mixed.alias("v")))), lambda s: s["v"]).alias("p"))
    if keys:
        named = kept.select(*names, *[f"_v{i}" for i in range(len(keys))]).distinct()
        rows = rows.join(named, names)
    out = stored(rows.select(*[F.col(f"_v{i}").alias(k) for i, k in enumerate(keys)], *(["held_out"] if leave_out else []), "n", "p"), "quantiles")
    released(*tables)
    if keys or leave_out:
        return out
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return one.join(out.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
