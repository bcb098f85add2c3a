"""Signal jobs: order intents from book tables, with positions from a table (0 where it has none).

Inputs have the columns of a tape with sides: day, timestamp, product, bids, asks. Outputs are rows of
intents (side, quantity signed, price, mechanism); nothing feeds fills back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import book, pricing, sizing
from tapeline.operators import series
from tapeline.operators.flow import informed_events
from tapeline.operators.asof import latest


def _positions(rows: DataFrame, positions: DataFrame | None, keys: list[str]) -> DataFrame:
    if positions is None:
        return rows.withColumn("position", F.lit(0).cast("long"))
    return rows.join(positions.select(*keys, "position"), keys, "left").withColumn("position", F.coalesce("position", F.lit(0)).cast("long"))


def _best(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bid", book.best_bid(F.col("bids"))).withColumn("ask", book.best_ask(F.col("asks")))


def _decided(rows: DataFrame, tiers, limit: int, extreme: float, target: Column, cap: Column | None = None) -> DataFrame:
    """Intents of rows with z, bid, ask, position: tier size against z; at `extreme` or beyond a take
    against the target or nothing, below it a quote."""
    rows = rows.withColumn("side", F.when(F.col("z") > 0, "sell").otherwise("buy")).withColumn("deviation", F.abs("z"))
    rows = rows.withColumn("size", sizing.tier_size(F.col("deviation"), tiers, F.col("position"), limit, F.col("side"))).filter("size > 0")
    market = F.when(F.col("side") == "buy", F.col("ask")).otherwise(F.col("bid"))
    hard = F.col("deviation") >= extreme
    take = sizing.order_price(sizing.take_price(target, market.cast("double"), F.col("side")))
    rows = rows.withColumn("price", F.when(hard, take).otherwise(sizing.improved_quote(F.col("bid"), F.col("ask"), F.col("side"))))
    rows = rows.withColumn("mechanism", F.when(hard, "aggressive").otherwise("passive")).filter("price IS NOT NULL")
    return rows.withColumn("quantity", F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")))


def reversion(books: DataFrame, tiers, window: int, extreme: float, limit: int = 50, fair: Column | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Intents against the z-score of the fair value (by default the mid) over usable books."""
    rows = _best(books.filter(book.usable(F.col("bids"), F.col("asks"))))
    rows = rows.withColumn("fair", book.naive_mid(F.col("bids"), F.col("asks")) if fair is None else fair)
    rows = series.zscores(rows, "fair", window).filter("z IS NOT NULL")
    rows = _positions(rows, positions, ["day", "timestamp", "product"])
    return _decided(rows, tiers, limit, extreme, F.col("roll_mean")).select("day", "timestamp", "product", "z", "side", "quantity", "price", "mechanism")


def iv_reversion(ivs: DataFrame, tiers, window: int, extreme: float, limit: int = 50, positions: DataFrame | None = None) -> DataFrame:
    """Intents against the z-score of implied volatility; a take must beat the price at the mean iv.
    ivs: day, timestamp, strike, spot, tte, iv, bid, ask; the window counts valid ivs only."""
    rows = series.zscores(ivs.filter("iv IS NOT NULL"), "iv", window, ("day", "strike")).filter("z IS NOT NULL")
    rows = _positions(rows, positions, ["day", "timestamp", "strike"])
    fair = pricing.call_price(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("roll_mean"))
    out = _decided(rows, tiers, limit, extreme, fair)
    delta = pricing.call_delta(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("iv"))
    return out.select("day", "timestamp", "strike", "z", "side", "quantity", "price", "mechanism", delta.alias("delta"))


def ladder_sweep(books: DataFrame, slope: float, guard: float, edge: float, limit: int = 50, positions: DataFrame | None = None) -> DataFrame:
    """Buys every ask up to fair + edge, cheapest first, within the room; fair starts at the day's first
    mid and follows the slope. Once the mid strays over `guard` from it, the key stays halted."""
    rows = books.filter(book.usable(F.col("bids"), F.col("asks"))).withColumn("mid", book.naive_mid(F.col("bids"), F.col("asks")))
    rows = series.start_anchor(rows, "mid", slope, guard).filter("NOT halted")
    rows = _positions(rows, positions, ["day", "timestamp", "product"]).withColumn("room", F.greatest(F.lit(0), F.lit(limit) - F.col("position")))
    cheap = F.array_sort(F.filter("asks", lambda x: x["p"] <= F.col("fair") + edge))
    rows = rows.select("day", "timestamp", "product", "fair", "room", cheap.alias("ladder"))
    before = lambda i: F.aggregate(F.slice("ladder", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["v"])
    takes = F.transform("ladder", lambda x, i: F.struct(x["p"].alias("price"), F.least(x["v"], F.greatest(F.col("room") - F.when(i > 0, before(i)).otherwise(F.lit(0)), F.lit(0))).alias("quantity")))
    return rows.select("day", "timestamp", "product", "fair", F.explode(takes).alias("x")).select("day", "timestamp", "product", "fair", "x.price", "x.quantity").filter("quantity > 0")


def basket(panel: DataFrame, target: float, tiers, window: int, extreme: float, limit: int = 50, positions: DataFrame | None = None) -> DataFrame:
    """Intents against the z-score of each member's distance from target less the others' sum. panel:
    day, timestamp, family, product, mid_price, bid, ask, of ticks at which every member has a book."""
    rows = series.family_totals(panel).withColumn("fair", F.lit(target) - F.col("others")).withColumn("dev", F.col("mid_price") - F.col("fair"))
    rows = series.zscores(rows, "dev", window).filter("z IS NOT NULL")
    rows = _positions(rows, positions, ["day", "timestamp", "product"])
    return _decided(rows, tiers, limit, extreme, F.col("fair") + F.col("roll_mean")).select("day", "timestamp", "product", "z", "side", "quantity", "price", "mechanism")


def pair(books: DataFrame, a, b, tiers, window: int, extreme: float, limit: int = 50, positions: DataFrame | None = None) -> DataFrame:
    """Both legs' intents against the z-score of the spread: equal sizes on opposite sides; a take needs
    the edge on both legs. books: day, timestamp, product, mid_price, bid, ask."""
    leg = lambda p, t: books.filter(F.col("product") == p).select("day", "timestamp", *[F.col(c).alias(f"{c}_{t}") for c in ("mid_price", "bid", "ask")])
    rows = leg(a, "a").join(leg(b, "b"), ["day", "timestamp"]).withColumn("spread", F.col("mid_price_a") - F.col("mid_price_b"))
    rows = series.zscores(rows, "spread", window, ("day",)).filter("z IS NOT NULL").withColumn("deviation", F.abs("z"))
    for t, p, up in (("a", a, "sell"), ("b", b, "buy")):
        own = None if positions is None else positions.filter(F.col("product") == p)
        rows = _positions(rows, own, ["day", "timestamp"]).withColumn(f"side_{t}", F.when(F.col("z") > 0, up).otherwise("sell" if up == "buy" else "buy"))
        rows = rows.withColumn(f"size_{t}", sizing.tier_size(F.col("deviation"), tiers, F.col("position"), limit, F.col(f"side_{t}"))).drop("position")
    rows = rows.withColumn("size", F.least("size_a", "size_b")).filter("size > 0")
    hard = F.col("deviation") >= extreme
    for t, fair in (("a", F.col("mid_price_b") + F.col("roll_mean")), ("b", F.col("mid_price_a") - F.col("roll_mean"))):
        side = F.col(f"side_{t}")
        market = F.when(side == "buy", F.col(f"ask_{t}")).otherwise(F.col(f"bid_{t}")).cast("double")
        rows = rows.withColumn(f"price_{t}", F.when(hard, sizing.order_price(sizing.take_price(fair, market, side))).otherwise(sizing.improved_quote(F.col(f"bid_{t}"), F.col(f"ask_{t}"), side)))
    rows = rows.filter("price_a IS NOT NULL AND price_b IS NOT NULL")
    leg = lambda t, p: F.struct(F.lit(p).alias("product"), F.col(f"side_{t}").alias("side"), F.col(f"price_{t}").alias("price"))
    rows = rows.select("day", "timestamp", "z", "size", F.when(hard, "aggressive").otherwise("passive").alias("mechanism"), F.explode(F.array(leg("a", a), leg("b", b))).alias("x"))
    return rows.select("day", "timestamp", "x.product", "z", "x.side", F.when(F.col("x.side") == "buy", F.col("size")).otherwise(-F.col("size")).alias("quantity"), "x.price", "mechanism")


def outer_quotes(books: DataFrame, size: int = 3, limit: int = 50, positions: DataFrame | None = None) -> DataFrame:
    """A quote on each side, up to `size` and the room; crossed and one-sided books have none."""
    rows = _best(books.filter(book.usable(F.col("bids"), F.col("asks")))).filter("bid < ask")
    rows = _positions(rows, positions, ["day", "timestamp", "product"])
    one = lambda s: F.struct(F.lit(s).alias("side"), sizing.tier_size(F.lit(0.0), [(0.0, size)], F.col("position"), limit, F.lit(s)).alias("size"), sizing.improved_quote(F.col("bid"), F.col("ask"), F.lit(s)).alias("price"))
    rows = rows.select("day", "timestamp", "product", F.explode(F.array(one("buy"), one("sell"))).alias("x")).filter("x.size > 0")
    return rows.select("day", "timestamp", "product", "x.side", F.when(F.col("x.side") == "buy", F.col("x.size")).otherwise(-F.col("x.size")).alias("quantity"), "x.price")


def net_exposure(held: DataFrame) -> DataFrame:
    """day, timestamp, exposure: positions times deltas; without a delta (no quote) they count as 0.
    held: day, timestamp, strike (null for the underlying), position, delta (1 for the underlying).

    A tick's few terms are added in strike order, the underlying first: caps cut whole units, so that the last
    digit of a sum can decide on one, and it must not depend on the order of rows.
    """
    term = F.struct("strike", (F.col("position") * F.coalesce("delta", F.lit(0.0))).alias("exposure"))
    ticks = held.groupBy("day", "timestamp").agg(F.sort_array(F.collect_list(term)).alias("terms"))
    add = lambda acc, x: F.coalesce(F.coalesce(acc, F.lit(0.0)) + x["exposure"], acc)
    return ticks.select("day", "timestamp", F.aggregate("terms", F.lit(None).cast("double"), add).alias("exposure"))


def capped_in_turn(wanted: DataFrame, exposure: DataFrame, cap: float, reduce: int = 5) -> DataFrame:
    """Orders of a tick one strike after the other, on one running exposure.

    wanted: day, timestamp, strike, quantity, price, delta, position, bid, ask: every quoted strike of
    the tick, quantity 0 without a signal. An order is cut to what the cap leaves. A strike without
    an order quotes to reduce, if the tick's exposure is at the cap or over and its position is on the
    same side. Ticks are independent; a tick's few strikes are folded in strike order.
    """
    item = F.struct("strike", "quantity", "price", "delta", "position", "bid", "ask")
    ticks = wanted.groupBy("day", "timestamp").agg(F.sort_array(F.collect_list(item)).alias("items"))
    ticks = ticks.join(exposure, ["day", "timestamp"], "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    kind = "array<struct<strike:int,quantity:bigint,price:bigint,mechanism:string>>"
    start = F.struct(F.col("exposure").alias("run"), F.array().cast(kind).alias("out"))
    over = F.abs("exposure") >= cap

    def turn(acc: Column, x: Column) -> Column:
        own = sizing.delta_capped(x["quantity"], x["delta"], acc["run"], cap)
        side = F.when(x["position"] > 0, "sell").otherwise("buy")
        same = over & (x["position"] != 0) & ((x["position"] > 0) == (F.col("exposure") > 0)) & (x["bid"] < x["ask"])
        less = F.least(F.lit(reduce).cast("long"), F.abs(x["position"]).cast("long")) * F.when(side == "sell", -1).otherwise(1)
        quantity = F.when(own != 0, own).when(same, less).otherwise(F.lit(0).cast("long"))
        price = F.when(own != 0, x["price"]).otherwise(sizing.improved_quote(x["bid"], x["ask"], side))
        name = F.when(own != 0, "signal").otherwise("reduce")
        order = F.struct(x["strike"].cast("int").alias("strike"), quantity.alias("quantity"), price.cast("long").alias("price"), name.alias("mechanism"))
        return F.struct((acc["run"] + quantity * F.coalesce(x["delta"], F.lit(0.0))).alias("run"), F.concat(acc["out"], F.array(order)).cast(kind).alias("out"))

    out = F.aggregate("items", start, turn)
    rows = ticks.select("day", "timestamp", out.alias("r")).select("day", "timestamp", F.col("r.run").alias("exposure_after"), F.explode("r.out").alias("x"))
    return rows.select("day", "timestamp", "exposure_after", "x.*").filter("quantity <> 0")


def informed_filter(intents: DataFrame, trades: DataFrame, informed: list[str], lookback: int, tick: int = 100, enabled: bool = False) -> DataFrame:
    """Intents without the aggressive ones that the latest informed trade contradicts. Off by default."""
    if not enabled:
        return intents
    found = latest(intents, informed_events(trades, informed), ["day", "product"], "timestamp", F.col("way"), "timestamp", lookback * tick)
    against = (F.col("mechanism") == "aggressive") & (F.col("event.value") == F.when(F.col("side") == "buy", -1).otherwise(1))
    return found.filter(~F.coalesce(against, F.lit(False))).drop("event")


def hedge_targets(held: DataFrame, vol: float = 0.012, limit: int = 50, target: int = 10) -> DataFrame:
    """day, timestamp, option_buy, hedge: options bought up to `target` at the first ask, and the spot
    order that takes -round(options x delta) within limit and the first level's volume. Without a delta,
    so at or past expiry, there is no hedge.

    held: day, timestamp, spot, strike, tte, option_position, spot_position, option_ask_volume,
    spot_bid_volume, spot_ask_volume.
    """
    buy = F.greatest(F.lit(0), F.least(F.col("option_ask_volume"), F.lit(target) - F.col("option_position")))
    rows = held.withColumn("option_buy", F.coalesce(buy, F.lit(0)).cast("long"))
    delta = pricing.call_delta(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), vol)
    want = -F.bround((F.col("option_position") + F.col("option_buy")) * delta) - F.col("spot_position")
    want = F.greatest(-F.lit(limit) - F.col("spot_position"), F.least(F.lit(limit) - F.col("spot_position"), want))
    hedge = F.when(delta.isNull(), F.lit(0)).when(want > 0, F.least(want, F.col("spot_ask_volume"))).when(want < 0, -F.least(-want, F.col("spot_bid_volume"))).otherwise(F.lit(0))
    return rows.select("day", "timestamp", "option_buy", F.coalesce(hedge, F.lit(0)).cast("long").alias("hedge"))


def tier_fires(z: DataFrame, tiers, keys: tuple[str, ...] = ("product",), value: str = "deviation") -> DataFrame:
    """Per key and tier reached: fires, median, mean, 10th and 90th percentiles of |deviation|. z: z, value."""
    tier = F.lit(0)
    for k, (threshold, _) in enumerate(tiers, 1):
        tier = F.when(F.abs("z") >= threshold, F.lit(k)).otherwise(tier)
    d = F.abs(value)
    agg = z.withColumn("tier", tier).filter("tier > 0").groupBy(*keys, "tier").agg(
        F.count("*").alias("fires"), F.avg(d).alias("mean"), F.percentile(d, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")
    )
    return agg.select(*keys, "tier", "fires", "mean", F.get("p", F.lit(0)).alias("p10"), F.get("p", F.lit(1)).alias("median"), F.get("p", F.lit(2)).alias("p90"))


def excursion(exposure: DataFrame, cap: float, share: float = 0.9) -> DataFrame:
    """Per day: the largest |exposure|, and ticks over a share of the cap."""
    size = F.abs("exposure")
    return exposure.groupBy("day").agg(F.max(size).alias("max_exposure"), F.sum((size > share * cap).cast("long")).alias("ticks_over"), F.count("*").alias("ticks"))
