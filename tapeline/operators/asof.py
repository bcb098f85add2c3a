"""As-of joins: the latest event at or before each row.

Keys are cut into spans of time. The last event of a span is handed on to the spans after it, one row a span, so every
span finds its rows' events by itself and a hot key spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.scratch import stored
from tapeline.operators.series import SPAN


def latest(rows: DataFrame, events: DataFrame, keys: list[str], time: str, value: Column, tie: str | None = None, tolerance: int | None = None, out: str = "event", span: int = SPAN) -> DataFrame:
    """rows with `out`: struct(at, value) of the key's latest event at or before the row's time.

    Events at a row's own time count. Of events at one time the one with the largest `tie` wins.
    An event more than `tolerance` before the row does not count. Keys are not null. Rows are read once, and
    events once to be stored: from there they go to their spans, and their ends on to later ones.
    """
    own = [c for c in rows.columns]
    place = F.floor(F.col(time) / span)
    left = rows.select(*keys, F.col(time).alias("_t"), place.alias("_span"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), F.struct(*own).alias("_row"))
    tied = (F.lpad(F.col(tie).cast("string"), 20, "0") if tie else F.lit(None).cast("string")).alias("_tie")
    right = events.select(*keys, F.col(time).alias("_t"), place.alias("_span"), F.lit(0).alias("_side"), tied, F.struct(F.col(time).alias("at"), value.alias("value")).alias("_event"))
    right = stored(right, "events")

    # the last event of each span, and the spans up to the next one that has any
    ends = right.groupBy(*keys, "_span").agg(F.max_by(F.struct("_t", "_tie", "_event"), F.struct("_t", "_tie")).alias("_end"))
    ends = ends.withColumn("_next", F.lead("_span").over(Window.partitionBy(*keys).orderBy("_span")))  # a row a span
    near = F.col("_next") if tolerance is None else F.least("_next", F.floor((F.col("_end._t") + tolerance) / span))
    later = F.when(near > F.col("_span"), F.sequence(F.col("_span") + 1, near))
    handed = ends.filter("_next IS NOT NULL").select(*keys, F.col("_end._t").alias("_t"), F.explode(later).alias("_span"), F.lit(0).alias("_side"), F.col("_end._tie").alias("_tie"), F.col("_end._event").alias("_event"))
    final = ends.filter("_next IS NULL").select(*keys, F.col("_span").alias("_last"), F.col("_end._event").alias("_final"))  # a row a key

    no_row, no_event = F.lit(None).cast(left.schema["_row"].dataType), F.lit(None).cast(right.schema["_event"].dataType)
    both = left.withColumn("_event", no_event).unionByName(right.unionByName(handed).withColumn("_row", no_row))
    upto = Window.partitionBy(*keys, "_span").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_found", F.last("_event", ignorenulls=True).over(upto)).filter("_side = 1")
    both = both.join(final, keys, "left").withColumn("_found", F.coalesce("_found", F.when(F.col("_span") > F.col("_last"), F.col("_final"))))
    found = F.col("_found") if tolerance is None else F.when(F.col("_t") - F.col("_found.at") <= tolerance, F.col("_found"))
    return both.select("_row.*", found.alias(out))


def positions(fills: DataFrame, grid: DataFrame, keys: list[str], time: str = "timestamp", quantity: str = "signed", span: int = SPAN) -> DataFrame:
    """grid with position: the sum of the signed quantities of fills at or before the row; 0 before any."""
    steps = fills.groupBy(*keys, time).agg(F.sum(quantity).alias("step")).withColumn("_span", F.floor(F.col(time) / span))
    steps = stored(steps, "steps")
    # sums within a span, and those of the spans before it
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = steps.groupBy(*keys, "_span").agg(F.sum("step").alias("_sum")).select(*keys, "_span", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = Window.partitionBy(*keys, "_span").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("run", F.sum("step").over(run)).join(spans, [*keys, "_span"]).withColumn("run", F.col("run") + F.col("_before"))
    found = latest(grid, steps.select(*keys, time, "run"), keys, time, F.col("run"), span=span)
    return found.withColumn("position", F.coalesce("event.value", F.lit(0))).drop("event")
