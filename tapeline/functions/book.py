"""Order-book shape and fair value, as expressions on sides: arrays of (p, v) level structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.schema import LEVELS


def side(prefix: str) -> Column:
    """The levels of one side of a tape row, present ones only; of two levels at one price the later."""
    levels = F.array(*[F.struct(F.col(f"{prefix}_price_{k}").cast("long").alias("p"), F.col(f"{prefix}_volume_{k}").cast("long").alias("v")) for k in LEVELS])
    present = F.filter(levels, lambda x: x["p"].isNotNull() & x["v"].isNotNull())
    return F.filter(present, lambda x, i: ~F.exists(F.slice(present, i + 2, len(LEVELS)), lambda y: y["p"] == x["p"]))


def best_bid(bids: Column) -> Column:
    return F.array_max(F.transform(bids, lambda x: x["p"]))


def best_ask(asks: Column) -> Column:
    return F.array_min(F.transform(asks, lambda x: x["p"]))


def usable(bids: Column, asks: Column) -> Column:
    return (F.size(bids) > 0) & (F.size(asks) > 0)


def naive_mid(bids: Column, asks: Column) -> Column:
    """Mean of the best prices; null if a side is empty."""
    return (best_bid(bids) + best_ask(asks)) / F.lit(2.0)


def outer_anchor(bids: Column, asks: Column) -> Column:
    """Mean of the prices of each side's largest volume; ties: the highest bid, the lowest ask."""
    bid = F.array_max(F.transform(bids, lambda x: F.struct(x["v"].alias("v"), x["p"].alias("p"))))["p"]
    ask = -F.array_max(F.transform(asks, lambda x: F.struct(x["v"].alias("v"), (-x["p"]).alias("p"))))["p"]
    return (bid + ask) / F.lit(2.0)


def two_layer_value(bids: Column, asks: Column, max_inner_deviation: float) -> Column:
    """The mean of anchor and mid while they are near each other, or else the anchor."""
    anchor, mid = outer_anchor(bids, asks), naive_mid(bids, asks)
    return F.when(F.abs(mid - anchor) <= max_inner_deviation, (anchor + mid) / F.lit(2.0)).otherwise(anchor)


def touch_spread() -> Column:
    return F.col("ask_price_1") - F.col("bid_price_1")
