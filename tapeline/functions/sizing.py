"""Order sizes and prices, as expressions. Sides are the strings buy and sell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier_size(deviation: Column, tiers: list[tuple[float, int]], position: Column, limit: int, side: Column) -> Column:
    """The size of the highest tier that the deviation reaches, within the room that the limit leaves."""
    if not tiers or any(b[0] <= a[0] for a, b in zip(tiers, tiers[1:])) or any(size < 0 for _, size in tiers):
        raise ValueError("tiers ascend strictly by threshold, with sizes of 0 or more")
    size = F.lit(0)
    for threshold, amount in tiers:
        size = F.when(deviation >= threshold, F.lit(amount)).otherwise(size)
    room = F.when(side == "buy", F.lit(limit) - position).otherwise(position + F.lit(limit))
    return F.least(size.cast("long"), F.greatest(F.lit(0).cast("long"), room.cast("long")))


def exposure_capped(quantity: Column, exposure: Column, cap: float) -> Column:
    """The part of a signed quantity that keeps the exposure within the cap, truncated."""
    if cap <= 0:
        raise ValueError("the cap is positive")
    up = F.least(quantity, F.floor(F.greatest(F.lit(0.0), F.lit(cap) - exposure)))
    down = -F.least(-quantity, F.floor(F.greatest(F.lit(0.0), F.lit(cap) + exposure)))
    return F.when(quantity > 0, up).when(quantity < 0, down).otherwise(F.lit(0)).cast("long")


def delta_capped(quantity: Column, delta: Column, exposure: Column, cap: float) -> Column:
    """The same for options: a unit moves the exposure by delta; 0 if delta is not positive."""
    room = F.greatest(F.lit(0.0), F.lit(cap) - F.when(quantity > 0, exposure).otherwise(-exposure))
    most = F.least(F.abs(quantity), F.floor(F.try_divide(room, delta)))
    return F.when((quantity == 0) | (delta <= 0), F.lit(0)).when(quantity > 0, most).otherwise(-most).cast("long")


def take_price(fair: Column, market: Column, side: Column, threshold: float = 0.0) -> Column:
    """The market price if its edge over fair reaches the threshold, or else null."""
    edge = F.when(side == "buy", fair - market).otherwise(market - fair)
    return F.when(edge >= threshold, market)


def improved_quote(bid: Column, ask: Column, side: Column, tick: int = 1, strict: bool = False) -> Column:
    """One tick better than the own side's best, but short of the other side; null if crossed."""
    if tick <= 0:
        raise ValueError("the tick is positive")
    buy = F.greatest(F.when(bid + tick >= ask, ask - tick).otherwise(bid + tick), bid)
    sell = F.least(F.when(ask - tick <= bid, bid + tick).otherwise(ask - tick), ask)
    crossed = F.raise_error(F.lit("crossed or locked book")).cast("long") if strict else F.lit(None).cast("long")
    return F.when(bid >= ask, crossed).when(side == "buy", buy).otherwise(sell)


def order_price(price: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(price).cast("long")


def grid_distance(change: Column, modulus: float) -> Column:
    """How far a change is from its nearest multiple of the modulus (halves to even)."""
    return F.abs(change - F.bround(change / modulus) * modulus)
