"""Statistics of book shape over a price tape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import book
from tapeline.schema import LEVELS


def with_sides(prices: DataFrame) -> DataFrame:
    return prices.withColumn("bids", book.side("bid")).withColumn("asks", book.side("ask"))


def level_stats(prices: DataFrame, keys: tuple[str, ...] = ("day", "product")) -> DataFrame:
    """Per key and level: shares of rows with a bid and an ask, mean volumes of those present."""
    level = lambda k: F.struct(
        F.lit(k).alias("level"), F.col(f"bid_price_{k}").alias("bp"), F.col(f"bid_volume_{k}").cast("double").alias("bv"),
        F.col(f"ask_price_{k}").alias("ap"), F.col(f"ask_volume_{k}").cast("double").alias("av"),
    )
    rows = prices.select(*keys, F.explode(F.array(*[level(k) for k in LEVELS])).alias("shape")).select(*keys, "shape.*")
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return rows.groupBy(*keys, "level").agg(
        share("bp").alias("bid_presence"), share("ap").alias("ask_presence"), F.avg("bv").alias("bid_volume"), F.avg("av").alias("ask_volume")
    )


def anchor_against_mid(prices: DataFrame, keys: tuple[str, ...] = ("day", "product")) -> DataFrame:
    """Per key: usable and all rows, mean, median and largest distance of anchor and mid, share apart."""
    rows = with_sides(prices)
    apart = F.abs(book.outer_anchor(F.col("bids"), F.col("asks")) - book.naive_mid(F.col("bids"), F.col("asks")))
    rows = rows.select(*keys, F.when(book.usable(F.col("bids"), F.col("asks")), apart).alias("apart"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("apart").alias("usable"), F.count("*").alias("ticks"), none(F.avg("apart")).alias("mean_apart"), none(F.median("apart")).alias("median_apart"),
        none(F.max("apart")).alias("max_apart"), none(F.avg((F.col("apart") > 0).cast("double"))).alias("share_apart"),
    )


def two_layer_series(prices: DataFrame, max_inner_deviation: float) -> DataFrame:
    """The tape's usable rows with fair: the two-layer value."""
    rows = with_sides(prices).filter(book.usable(F.col("bids"), F.col("asks")))
    return rows.withColumn("fair", book.two_layer_value(F.col("bids"), F.col("asks"), max_inner_deviation))


def spread_stats(prices: DataFrame, keys: tuple[str, ...] = ("day", "product")) -> DataFrame:
    """Per key: mean, median and count of the touch spread where both sides are there."""
    s = book.touch_spread()
    return prices.groupBy(*keys).agg(F.avg(s).alias("mean_spread"), F.median(s).alias("median_spread"), F.count(s).alias("n_spread"))


def volume_templates(prices: DataFrame) -> DataFrame:
    """product, template: the smallest product with the same series of best volumes, products of the
    template. The series hash adds up in any order; a null-safe join then confirms every pair."""
    own = F.xxhash64("day", "timestamp", "bid_volume_1", "ask_volume_1").cast("decimal(38,0)")
    hashes = prices.groupBy("product").agg(F.sum(own).alias("hash"), F.count("*").alias("n"))
    groups = hashes.groupBy("hash", "n").agg(F.min("product").alias("template"), F.count("*").alias("products"))
    named = hashes.join(groups, ["hash", "n"]).select("product", "template", "products", "n")
    volumes = prices.select("product", "day", "timestamp", "bid_volume_1", "ask_volume_1")
    mine = volumes.join(named.filter("product <> template").select("product", "template"), "product")
    base = volumes.select(F.col("product").alias("template"), "day", "timestamp", F.col("bid_volume_1").alias("b"), F.col("ask_volume_1").alias("a"))
    pair = mine.join(base, ["template", "day", "timestamp"])
    same = pair.groupBy("product").agg(F.sum((F.col("b").eqNullSafe(F.col("bid_volume_1")) & F.col("a").eqNullSafe(F.col("ask_volume_1"))).cast("long")).alias("same"))
    out = named.join(same, "product", "left")
    return out.filter((F.col("product") == F.col("template")) | (F.col("same") == F.col("n"))).select("product", "template", "products")
