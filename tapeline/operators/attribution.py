"""Where profit comes from: run logs, fills, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import correlation, sums
from tapeline.operators.asof import positions


def final_pnl(activities: DataFrame, run: str = "run") -> DataFrame:
    """Profit at each run's and day's last timestamp, by product; products without a row there are left out."""
    last = F.max("timestamp").over(Window.partitionBy(run, "day"))
    return activities.withColumn("_last", last).filter("timestamp = _last").select(run, "day", "product", "profit_and_loss")


def pnl_rollup(final: DataFrame, run: str = "run") -> DataFrame:
    """Totals by product, by run, and over all (nulls mark totals)."""
    return final.rollup(run, "product").agg(F.sum("profit_and_loss").alias("pnl"))


def day_rollup(final: DataFrame) -> DataFrame:
    """Per day: total, negative products, and the day's distance from the mean of days."""
    days = final.groupBy("day").agg(F.sum("profit_and_loss").alias("pnl"), F.sum((F.col("profit_and_loss") < 0).cast("long")).alias("negative_products"))
    mean = days.agg(F.avg("pnl").alias("mean_pnl"), F.min("pnl").alias("worst_pnl"))
    return days.crossJoin(F.broadcast(mean)).withColumn("worst", F.col("pnl") == F.col("worst_pnl")).drop("worst_pnl")  # one row


def signed(trades: DataFrame, account: str) -> DataFrame:
    """The account's fills with signed quantity; a trade with itself is two fills."""
    mine = F.filter(
        F.array(F.struct(F.col("buyer").alias("who"), F.col("quantity").alias("signed")), F.struct(F.col("seller").alias("who"), (-F.col("quantity")).alias("signed"))),
        lambda x: x["who"] == account,
    )
    return trades.select("*", F.explode(mine).alias("x")).withColumn("signed", F.col("x.signed")).drop("x").withColumnRenamed("symbol", "product")


def fill_stats(trades: DataFrame, account: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per key: own fills, bought and sold volume, mean price by volume (0 without volume). A trade with
    itself counts its price once and its volume on both sides."""
    own = trades.filter((F.col("buyer") == account) | (F.col("seller") == account))
    bought = F.sum(F.when(F.col("buyer") == account, F.col("quantity")).otherwise(0))
    sold = F.sum(F.when(F.col("seller") == account, F.col("quantity")).otherwise(0))
    agg = own.groupBy(*keys).agg(F.count("*").alias("n_fills"), bought.alias("buy_volume"), sold.alias("sell_volume"), F.sum(F.col("price") * F.col("quantity")).alias("_paid"))
    mean = F.coalesce(F.try_divide("_paid", F.col("buy_volume") + F.col("sell_volume")), F.lit(0.0))
    return agg.withColumn("avg_fill_price", mean).drop("_paid")


def attributed(fills: DataFrame, intents: DataFrame) -> DataFrame:
    """Fills with the mechanism of the intent of the same (day, timestamp, product), or unattributed."""
    tags = intents.groupBy("day", "timestamp", "product").agg(F.min("mechanism").alias("mechanism"))
    return fills.join(tags, ["day", "timestamp", "product"], "left").withColumn("mechanism", F.coalesce("mechanism", F.lit("unattributed")))


def mechanism_pnl(fills: DataFrame, mids: DataFrame, run_keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """Per product and mechanism: fills, profit at the day's last mid, and residue: what the product's
    total has beyond its mechanisms (0 if all reconcile)."""
    last = mids.groupBy("day", "product").agg(F.max_by("mid_price", "timestamp").alias("final_mid"))
    rows = fills.join(last, ["day", "product"]).withColumn("pnl", (F.col("final_mid") - F.col("price")) * F.col("signed"))
    parts = rows.groupBy("product", "mechanism").agg(F.count("*").alias("fills"), F.sum("pnl").alias("pnl"))
    # the same total from cash and position: what was paid, and what is held at the end
    held = rows.groupBy("day", "product", "final_mid").agg(F.sum("signed").alias("position"), F.sum(F.col("price") * F.col("signed")).alias("paid"))
    total = held.groupBy("product").agg(F.sum(F.col("position") * F.col("final_mid") - F.col("paid")).alias("total"))
    out = parts.join(total, "product")
    return out.withColumn("residue", F.col("total") - F.sum("pnl").over(Window.partitionBy("product"))).drop("total")


def position_series(fills: DataFrame, grid: DataFrame) -> DataFrame:
    """grid (day, product, timestamp) with the position held at each tick."""
    return positions(fills, grid, ["day", "product"])


def position_correlation(held: DataFrame) -> DataFrame:
    """a, b, corr of positions of different products at common ticks (0 without variance)."""
    tick = F.sort_array(F.collect_list(F.struct("product", F.col("position").cast("double").alias("v"))))
    ticks = held.groupBy("day", "timestamp").agg(tick.alias("t"))  # as many items as products
    pair = lambda x, y: F.struct(x["product"].alias("a"), y["product"].alias("b"), x["v"].alias("x"), y["v"].alias("y"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: pair(x, y))))
    stats = ticks.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(*sums(F.col("x"), F.col("y")))
    return stats.select("a", "b", F.col("n").cast("long").alias("n"), correlation(0.0).alias("corr"))
