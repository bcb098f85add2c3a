"""Counterparty scoring: how well each trader's trades do, given the regime at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.asof import latest
from tapeline.operators.bootstrap import oriented_p, poisson_weights, unit_draws
from tapeline.operators.quantiles import quantiles
from tapeline.operators.series import causal_regime, clean_mids

HORIZONS, TICK = (100, 500, 1000), 100


def trade_features(prices: DataFrame, trades: DataFrame, horizons: tuple[int, ...] = HORIZONS, window: int = 200, tick: int = TICK) -> DataFrame:
    """day, timestamp, product, bot, direction, abs_z, horizon, favourable, trade_id: each leg of each trade.

    The move goes from the trade's price to the mid exactly `horizon` ticks later, in the direction of
    the leg and in deviations. Trades without a regime or without any such mid have no rows.
    """
    regime = causal_regime(prices, window)
    if "trade_id" not in trades.columns:  # trades of one tick are different trades
        trades = trades.withColumn("trade_id", F.monotonically_increasing_id())
    rows = trades.withColumnRenamed("symbol", "product").join(regime.select("day", "product", "timestamp", "z", "std"), ["day", "product", "timestamp"])
    rows = rows.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    # any clean mid will do then: the regime matters at the trade only
    later = clean_mids(prices).select("day", "product", F.col("timestamp").alias("then"), F.col("mid_price").alias("later"))
    rows = rows.withColumn("then", F.col("timestamp") + F.col("horizon") * tick).join(later, ["day", "product", "then"])
    legs = F.explode(F.array(F.struct(F.col("buyer").alias("bot"), F.lit(1).alias("direction")), F.struct(F.col("seller").alias("bot"), F.lit(-1).alias("direction"))))
    rows = rows.select("*", legs.alias("leg"))
    return rows.select(
        "day", "timestamp", "product", "leg.bot", "leg.direction", F.abs("z").alias("abs_z"), "horizon", (F.col("leg.direction") * (F.col("later") - F.col("price")) / F.col("std")).alias("favourable"),
        "trade_id",
    )


def bucket_edges(value: Column, rows: DataFrame, buckets: int = 3) -> DataFrame:
    """One row: the inner quantile edges of a value over all rows."""
    return quantiles(rows, value, [k / buckets for k in range(1, buckets)]).select(F.col("p").alias("edges"))


def bucket_of(value: Column, edges: Column) -> Column:
    """How many edges are at or below the value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def with_buckets(features: DataFrame, buckets: int = 3) -> DataFrame:
    """Features with bucket: the tertile of |z| over all legs, each leg counted once."""
    legs = features.select("day", "timestamp", "product", "bot", "direction", "abs_z", *[c for c in ("trade_id",) if c in features.columns]).distinct()
    edges = bucket_edges(F.col("abs_z"), legs, buckets)
    return features.crossJoin(F.broadcast(edges)).withColumn("bucket", bucket_of(F.col("abs_z"), F.col("edges"))).drop("edges")  # one row


def leg_sums(bucketed: DataFrame) -> DataFrame:
    """day, horizon, bucket, bot, n, total: all that scores need of the legs."""
    return bucketed.groupBy("day", "horizon", "bucket", "bot").agg(F.count("*").cast("double").alias("n"), F.sum("favourable").alias("total"))


def _scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and bot: the mean excess over the mean of the others in the bucket (0 without others)."""
    whole = Window.partitionBy(*keys, "bucket")
    rows = sums.withColumn("_n", F.sum("n").over(whole)).withColumn("_t", F.sum("total").over(whole))
    base = F.coalesce(F.try_divide(F.col("_t") - F.col("total"), F.col("_n") - F.col("n")), F.lit(0.0))
    rows = rows.withColumn("excess", F.col("total") - F.col("n") * F.when(F.col("_n") - F.col("n") > 0, base).otherwise(F.lit(0.0)))
    return rows.groupBy(*keys, "bot").agg(F.sum("n").alias("n"), F.try_divide(F.sum("excess"), F.sum("n")).alias("score"))


def scores(sums: DataFrame) -> DataFrame:
    """horizon, bot, n, score."""
    pooled = sums.groupBy("horizon", "bucket", "bot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return _scores(pooled, ["horizon"])


def ranked(scored: DataFrame) -> DataFrame:
    """scores() with rank: 1 for the best bot of a horizon, of equals the first by name."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("horizon").orderBy(F.col("score").desc(), "bot")))


def day_bootstrap(sums: DataFrame, replicates: int, seed: int) -> DataFrame:
    """scores() with ci_low, ci_high, p, floored from resampled days: own means and baselines are both
    made anew in every replicate, and a bot without trades on the drawn days scores 0. A horizon's days are
    drawn from those on which any leg has it: late trades of a short day have no long horizon."""
    base = scores(sums)
    draws = unit_draws(sums.select("horizon", "day").distinct(), "day", replicates, seed, ("horizon",))
    again = draws.join(sums, ["horizon", "day"]).groupBy("replicate", "horizon", "bucket", "bot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    redone = _scores(again, ["replicate", "horizon"]).withColumnRenamed("score", "again").drop("n")
    every = base.select("horizon", "bot", "score").crossJoin(sums.sparkSession.range(replicates).select(F.col("id").alias("replicate")))
    full = every.join(redone, ["replicate", "horizon", "bot"], "left").withColumn("again", F.coalesce("again", F.lit(0.0)))
    ci = oriented_p(F.col("score"), "again", ["horizon", "bot"], replicates, full)
    return base.join(ci, ["horizon", "bot"])


def trade_bootstrap(bucketed: DataFrame, sums: DataFrame, bot: str, horizon: int, replicates: int, seed: int) -> DataFrame:
    """horizon, bot, n, score, ci_low, ci_high of one bot from resampled single trades: for comparison with
    the day bootstrap, which it understates.

    A replicate weighs each leg by a Poisson number of mean 1, the number of times a resample takes it. Weighted sums are
    added up where the legs are; what is shuffled is a row a replicate and task. A replicate that takes no leg counts for nothing.
    """
    pooled = sums.filter(F.col("horizon") == horizon).groupBy("bucket").agg(F.sum("n").alias("_n"), F.sum("total").alias("_t"), F.sum(F.when(F.col("bot") == bot, F.col("n"))).alias("_on"), F.sum(F.when(F.col("bot") == bot, F.col("total"))).alias("_ot"))
    base = pooled.select("bucket", F.coalesce(F.try_divide(F.col("_t") - F.col("_ot"), F.col("_n") - F.col("_on")), F.lit(0.0)).alias("base"))
    own = bucketed.filter((F.col("bot") == bot) & (F.col("horizon") == horizon)).join(base, "bucket")
    # legs of one tick and direction are told apart by their rank; equal ones are interchangeable
    names = ["day", "product", "timestamp", "direction"]
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("favourable"))
    own = own.select(F.concat_ws(":", *[F.col(c).cast("string") for c in names], rank.cast("string")).alias("leg"), (F.col("favourable") - F.col("base")).alias("excess"))
    size = own.agg(F.count("*").alias("n"), F.avg("excess").alias("score"))
    each = own.select("excess", F.posexplode(poisson_weights(seed, F.col("leg"), replicates)).alias("replicate", "weight"))
    means = each.groupBy("replicate").agg(F.try_divide(F.sum(F.col("weight") * F.col("excess")), F.sum("weight")).alias("again"))
    ci = means.agg(F.percentile("again", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return size.crossJoin(ci).select(
        F.lit(horizon).alias("horizon"), F.lit(bot).alias("bot"), "n", "score", F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high")
    )


def verdicts(scored: DataFrame) -> DataFrame:
    """Adds verdict (by the interval of the horizon) and informed (positive verdict, and scores of one
    sign at all of the bot's horizons)."""
    verdict = F.when(F.col("ci_low") > 0, "positive").when(F.col("ci_high") < 0, "negative").otherwise("not significant")
    signs = F.min("score").over(Window.partitionBy("bot")) > 0
    return scored.withColumn("verdict", verdict).withColumn("informed", (F.col("verdict") == "positive") & signs)


def directional_split(features: DataFrame) -> DataFrame:
    """Per horizon and bot: n, share of right calls, means of right, wrong and all moves."""
    v = F.col("favourable")
    return features.groupBy("horizon", "bot").agg(
        F.count("*").alias("n"), F.avg((v > 0).cast("double")).alias("share_right"), F.avg(F.when(v > 0, v)).alias("mean_right"), F.avg(F.when(v <= 0, v)).alias("mean_wrong"), F.avg(v).alias("mean_all")
    )


def benchmark_check(sums: DataFrame) -> DataFrame:
    """Per horizon: the volume-weighted mean of self-excluding scores, and the same against baselines
    that include the bot, which is 0 by construction."""
    weighted = scores(sums).groupBy("horizon").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("excluding"), F.sum("n").cast("long").alias("n"))
    mean = F.sum("total").over(Window.partitionBy("horizon", "bucket")) / F.sum("n").over(Window.partitionBy("horizon", "bucket"))
    pooled = sums.withColumn("_e", F.col("total") - F.col("n") * mean).groupBy("horizon").agg((F.sum("_e") / F.sum("n")).alias("pooled"))
    return weighted.join(pooled, "horizon")


def trade_audit(prices: DataFrame, trades: DataFrame, bot: str, product: str, horizon: int, limit: int = 10, window: int = 200, tick: int = TICK) -> DataFrame:
    """The first `limit` trades of a bot in a product, with every intermediate value; the buyer's side
    counts if the bot is on both."""
    own_prices = prices.filter(F.col("product") == product)
    regime = causal_regime(own_prices, window)
    own = trades.filter((F.col("symbol") == product) & ((F.col("buyer") == bot) | (F.col("seller") == bot)))
    own = own.join(regime.select("day", "timestamp", "z", "std"), ["day", "timestamp"]).withColumn("then", F.col("timestamp") + horizon * tick)
    later = clean_mids(own_prices).select("day", F.col("timestamp").alias("then"), F.col("mid_price").alias("later"))
    rows = own.join(later, ["day", "then"], "left").withColumn("direction", F.when(F.col("buyer") == bot, 1).otherwise(-1))
    rows = rows.withColumn("favourable", F.col("direction") * (F.col("later") - F.col("price")) / F.col("std"))
    return rows.select("day", "timestamp", "direction", "price", "z", "std", "later", "favourable").orderBy("day", "timestamp").limit(limit)


def overlap(trades: DataFrame, fills: DataFrame) -> DataFrame:
    """Per bot: legs, and the share of them at a (day, timestamp) of own fills in any product."""
    legs = trades.select("day", "timestamp", F.explode(F.array("buyer", "seller")).alias("bot"))
    ticks = fills.select("day", "timestamp").distinct().withColumn("hit", F.lit(1.0))
    return legs.join(ticks, ["day", "timestamp"], "left").groupBy("bot").agg(F.count("*").alias("legs"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("overlap"))


def informed_events(trades: DataFrame, informed: list[str]) -> DataFrame:
    """Trades with an informed trader: direction +1 if it buys; the seller's word counts over the buyer's."""
    way = F.when(F.col("seller").isin(informed), -1).when(F.col("buyer").isin(informed), 1)
    return trades.withColumn("way", way).filter("way IS NOT NULL").withColumnRenamed("symbol", "product")


def informed_gap(trades: DataFrame, informed: list[str], tick: int = TICK) -> DataFrame:
    """Per product: median ticks between informed trades of a day."""
    rows = informed_events(trades, informed)
    gap = (F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("day", "product").orderBy("timestamp"))) / tick
    return rows.withColumn("gap", gap).groupBy("product").agg(F.median("gap").alias("median_gap"), F.count("*").alias("n"))


def informed_tally(ticks: DataFrame, trades: DataFrame, informed: list[str], extreme: float, lookback: int, tick: int = TICK) -> DataFrame:
    """Per product: ticks with |z| at or over `extreme` whose signal has the same or the opposite
    direction of the latest informed trade in the lookback, or none. ticks: with z."""
    rows = ticks.filter(F.abs("z") >= extreme).select("day", "product", "timestamp", F.when(F.col("z") > 0, -1).otherwise(1).alias("signal"))
    events = informed_events(trades, informed)
    found = latest(rows, events, ["day", "product"], "timestamp", F.col("way"), "timestamp", lookback * tick)
    way = F.col("event.value")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return found.groupBy("product").agg(n(way == F.col("signal")).alias("same"), n(way == -F.col("signal")).alias("opposite"), n(way.isNull()).alias("none"))
