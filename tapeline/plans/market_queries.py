"""Queries over books, panels and option quotes, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.functions import book as B
from tapeline.functions import pricing, sizing
from tapeline.operators import book, cross, options, regime, series, signals
from tapeline.plans import fixtures
from tapeline.plans.fixtures import BOOK_LEVELS, PANEL, QUOTE_INPUTS, TICKS, TRADES
from tapeline.plans.ticks_queries import DAYS, FLOORED, INFORMED, P_OF, REPS, SEED, W, _draw, r6
from tapeline.sources import tape

TIERS = [(1.0, 5), (1.5, 10), (2.0, 20)]
EXTREME, LAGS, TARGET = 1.8, list(range(-3, 4)), 5_000_000.0
EXPIRIES = [8.0, 8.25, 8.5, 9.0, 10.0]


# ------------------------------------------------------------------------------------------ books


def level_stats(spark, sf):
    return book.level_stats(fixtures.book_tape(spark, sf)).select("day", "product", "level", *r6("bid_presence", "ask_presence", "bid_volume", "ask_volume"))


def outer_vs_mid(spark, sf):
    out = book.anchor_against_mid(fixtures.book_tape(spark, sf))
    return out.select("day", "product", "usable", "ticks", *r6("mean_apart", "median_apart", "max_apart", "share_apart"))


def two_layer_value(spark, sf):
    return book.two_layer_series(fixtures.book_tape(spark, sf), 2.0).select("day", "product", "timestamp", *r6("fair"))


def touch_spread(spark, sf):
    return book.spread_stats(fixtures.book_tape(spark, sf)).select("day", "product", "n_spread", *r6("mean_spread", "median_spread"))


def volume_templates(spark, sf):
    return book.volume_templates(fixtures.book_tape(spark, sf))


def _books(spark, sf):
    return book.with_sides(fixtures.book_tape(spark, sf)).select("day", "product", "timestamp", "bids", "asks")


def tier_sizes(spark, sf):
    rows = _books(spark, sf).filter(B.usable(F.col("bids"), F.col("asks")))
    dev = F.abs(B.naive_mid(F.col("bids"), F.col("asks")) - 10050.0) / 20.0
    side = F.when(F.col("timestamp") % 200 == 0, "buy").otherwise("sell")
    held = F.floor(F.col("timestamp") / 100) % 101 - 50
    size = sizing.tier_size(dev, TIERS, held, 50, side)
    return rows.select("day", "product", "timestamp", size.alias("size"), sizing.exposure_capped(size, held.cast("double") / 2, 25.0).alias("capped"))


def quote_prices(spark, sf):
    rows = _books(spark, sf).filter(B.usable(F.col("bids"), F.col("asks"))).select("day", "product", "timestamp", B.best_bid(F.col("bids")).alias("bid"), B.best_ask(F.col("asks")).alias("ask"))
    q = lambda s: sizing.improved_quote(F.col("bid"), F.col("ask"), F.lit(s))
    return rows.select("day", "product", "timestamp", q("buy").alias("buy"), q("sell").alias("sell"), sizing.order_price((F.col("bid") + F.col("ask")) / 2).alias("mid_price"))


def reversion_signal(spark, sf):
    return signals.reversion(_books(spark, sf), TIERS, W, EXTREME).select("day", "product", "timestamp", "side", "quantity", "price", "mechanism", *r6("z"))


def trend_loader(spark, sf):
    return signals.ladder_sweep(_books(spark, sf), 0.001, 200.0, 5.0).select("day", "product", "timestamp", "price", "quantity", *r6("fair"))


def outer_quotes(spark, sf):
    return signals.outer_quotes(_books(spark, sf))


def tier_fires(spark, sf):
    z = series.zscore(book.two_layer_series(fixtures.book_tape(spark, sf), 2.0), "fair", W).filter("z IS NOT NULL").withColumn("deviation", F.col("fair") - F.col("roll_mean"))
    return signals.tier_fires(z, TIERS).select("product", "tier", "fires", *r6("mean", "p10", "median", "p90"))


def informed_filter(spark, sf):
    z = series.zscore(series.clean_mids(fixtures.ticks(spark, sf)), "mid_price", W).filter("z IS NOT NULL AND abs(z) >= 1.0")
    hard = F.abs("z") >= 1.5
    intents = z.select("day", "product", "timestamp", F.when(F.col("z") > 0, "sell").otherwise("buy").alias("side"), F.when(hard, "aggressive").otherwise("passive").alias("mechanism"))
    return signals.informed_filter(intents, fixtures.trades(spark, sf), INFORMED, 5, enabled=True)


# ------------------------------------------------------------------------------------------ panels


def _panel(spark, sf):
    return fixtures.panel(spark, sf)


def basket_within(spark, sf):
    return cross.within_families(_panel(spark, sf)).select("family", "product", "n", *r6("slope", "r2", "min_day_r2"), F.round("intercept", 2).alias("intercept"), "identity")


def basket_cross(spark, sf):
    return cross.across_families(_panel(spark, sf)).select("family", "product", "other", "n", *r6("slope", "r2", "min_day_r2"), "identity")


def basket_residual(spark, sf):
    return cross.basket_residuals(_panel(spark, sf), TARGET).select("day", "family", "n", F.round("std", 2).alias("std"), F.round("p90", 4).alias("p90"), F.round("p99", 4).alias("p99"))


def best_member(spark, sf):
    return cross.best_per_family(cross.within_families(_panel(spark, sf))).select("family", "product", *r6("r2"))


def family_corr(spark, sf):
    return cross.family_correlations(_panel(spark, sf)).select("day", "family", "a", "b", *r6("corr"))


def family_corr_mean(spark, sf):
    return cross.mean_off_diagonal(cross.family_correlations(_panel(spark, sf)), ["day", "family"]).select("day", "family", "pairs", *r6("mean_corr", "mean_abs_corr"))


def lead_lag(spark, sf):
    return cross.lead_lag(cross.lag_sums(_panel(spark, sf), LAGS)).select("family", "leader", "follower", "peak_lag", *r6("peak"))


def lead_lag_boot(spark, sf):
    out = cross.lead_lag_bootstrap(cross.lag_sums(_panel(spark, sf), LAGS), REPS, SEED)
    return out.select("family", "leader", "follower", "peak_lag", *r6("peak", "ci_low", "ci_high", "p"), "floored")


def lead_lag_summary(spark, sf):
    return cross.lead_lag_summary(cross.lead_lag_bootstrap(cross.lag_sums(_panel(spark, sf), LAGS), REPS, SEED))


def _edges(spark, sf):
    c = cross.lag_sums(_panel(spark, sf), [0]).groupBy("family", "leader", "follower").agg(*cross.merged())
    return c.select(F.col("family").alias("group"), F.col("leader").alias("a"), F.col("follower").alias("b"), cross.correlation(0.0).alias("weight"))


def pair_match(spark, sf):
    return cross.greedy_pairs(_edges(spark, sf)).select(F.col("group").alias("family"), "a", "b", *r6("weight"))


def _costs(panel):
    return panel.select("day", "product").distinct().withColumn("median_spread", 1.0 + F.col("product") % 4)


def pair_diagnostics(spark, sf):
    p = _panel(spark, sf)
    out = cross.pair_diagnostics(p, 5, 6, 5, 3, REPS, SEED, _costs(p))
    return out.select("day", *r6("phi", "trend_p", "round_trip_cost"), F.round("half_life", 4).alias("half_life"), F.round("rolling_std", 2).alias("rolling_std"), F.round("amplitude_over_cost", 2).alias("amplitude_over_cost"))


def _panel_books(spark, sf):
    mid = F.round("mid_price").cast("long")
    return _panel(spark, sf).withColumn("bid", mid - 2).withColumn("ask", mid + 3)


def pair_signal(spark, sf):
    out = signals.pair(_panel_books(spark, sf), 5, 6, TIERS, 5, EXTREME)
    return out.select("day", "product", "timestamp", "side", "quantity", "price", "mechanism", *r6("z"))


def basket_signal(spark, sf):
    out = signals.basket(_panel_books(spark, sf).filter("family <> 0"), TARGET, TIERS, 5, EXTREME)
    return out.select("day", "product", "timestamp", "side", "quantity", "price", "mechanism", *r6("z"))


def tape_validation(spark, sf):
    return tape.product_sets(_panel(spark, sf)).join(tape.aligned(_panel(spark, sf)).groupBy("day").agg(F.count("*").alias("unaligned")), "day", "left").fillna(0, ["unaligned"])


# ------------------------------------------------------------------------------------------ options


def _ivs(spark, sf):
    return options.implied(fixtures.quotes(spark, sf))


def bs_price_delta_vega(spark, sf):
    q = fixtures.quotes(spark, sf)
    a = (F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("true_vol"))
    out = q.select("day", "timestamp", "strike", pricing.call_price(*a).alias("price"), pricing.call_delta(*a).alias("delta"), pricing.vega(*a).alias("vega"))
    return out.select("day", "timestamp", "strike", *r6("price", "delta", "vega"))


def implied_vol(spark, sf):
    return _ivs(spark, sf).select("day", "timestamp", "strike", F.round("iv", 5).alias("iv"))


def smile(spark, sf):
    return options.smile(_ivs(spark, sf)).select("day", "strike", "n", "skipped", *r6("mean_iv", "std_iv"))


def expiry_calibration(spark, sf):
    return options.expiry_scores(fixtures.quotes(spark, sf), EXPIRIES).select("expiry", *r6("dispersion"))


def calibrated_expiry(spark, sf):
    return options.calibrated_expiry(options.expiry_scores(fixtures.quotes(spark, sf), EXPIRIES)).select("expiry", *r6("dispersion"))


def expiry_by_strike(spark, sf):
    return options.calibrated_expiry_by_strike(fixtures.quotes(spark, sf), EXPIRIES).select("strike", "expiry", *r6("dispersion"))


def expiry_scan(spark, sf):
    return options.expiry_scan(fixtures.quotes(spark, sf)).select("scan", *r6("expiry", "dispersion"))


def scanned_expiry(spark, sf):
    return options.calibrated_expiry(options.expiry_scan(fixtures.quotes(spark, sf)).filter("scan = 'fine'")).select(*r6("expiry", "dispersion"))


def scanned_expiry_by_strike(spark, sf):
    return options.scanned_by_strike(fixtures.quotes(spark, sf)).select("strike", *r6("expiry", "dispersion"))


def iv_trend(spark, sf):
    out = options.trend_consistency(_ivs(spark, sf))
    return out.select("day", "strike", "n", F.round(F.col("relative_slope") * 1e6, 4).alias("per_million"))


def iv_reversion(spark, sf):
    return options.reversion(_ivs(spark, sf)).select("day", "strike", "n", "status", F.round("phi", 5).alias("phi"))


def single_edges(spark, sf):
    ivs = _ivs(spark, sf)
    out = options.single_edges(ivs, fixtures.strike_spreads(ivs), 50)
    return out.select("day", "strike", "n", F.round("vega", 3).alias("vega"), F.round("price_std", 4).alias("price_std"), *r6("mean_spread"), F.round("breakeven_z", 4).alias("breakeven_z"))


def pair_edges(spark, sf):
    ivs = _ivs(spark, sf).withColumn("iv", F.when(F.col("strike") % 200 == 0, F.col("iv") * 1.25).otherwise(F.col("iv")))
    out = options.pair_edges(ivs, fixtures.strike_spreads(ivs), 50)
    return out.select("day", "strike", "above", "n", F.round("vega", 3).alias("vega"), F.round("price_std", 4).alias("price_std"), *r6("cost"), F.round("breakeven_z", 4).alias("breakeven_z"))


def level_regression(spark, sf):
    return options.level_regression(fixtures.quotes(spark, sf)).select("day", "strike", "n", *r6("corr", "slope", "r2"))


def _iv_intents(spark, sf):
    mid = F.round("price").cast("long")
    ivs = _ivs(spark, sf).withColumn("bid", mid - 1).withColumn("ask", mid + 2)
    return ivs, signals.iv_reversion(ivs, TIERS, W, 1.4)


def iv_signal(spark, sf):
    return _iv_intents(spark, sf)[1].select("day", "timestamp", "strike", "side", "quantity", "price", "mechanism", F.round("z", 2).alias("z"))


def _held(quotes):
    """Option positions made up from the events' numbers, with current deltas: none at or past expiry."""
    delta = pricing.call_delta(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("true_vol"))
    position = (F.col("event_id") + F.col("strike") / 100) % 41 - 20
    return quotes.select("day", "timestamp", "strike", "spot", "tte", "price", "true_vol", "event_id", position.cast("long").alias("position"), F.when(~F.col("below_intrinsic"), delta).alias("delta"))


def _held_options(spark, sf):
    return _held(_ivs(spark, sf))


def net_exposure(spark, sf):
    return signals.net_exposure(_held_options(spark, sf)).select("day", "timestamp", *r6("exposure"))


def exposure_excursion(spark, sf):
    return signals.excursion(signals.net_exposure(_held(fixtures.quotes(spark, sf))), 60.0).select("day", "ticks", "ticks_over", *r6("max_exposure"))


def exposure_cap(spark, sf):
    h = _held_options(spark, sf)
    mid = F.round("price").cast("long")
    wanted = h.filter("delta IS NOT NULL").withColumn("quantity", ((F.col("event_id") * 7 + F.col("strike") / 100) % 31 - 15).cast("long")).withColumn("price", mid).withColumn("bid", mid - 1).withColumn("ask", mid + 2)
    out = signals.capped_in_turn(wanted, signals.net_exposure(h), 40.0)
    return out.select("day", "timestamp", "strike", "quantity", "price", "mechanism", F.round("exposure_after", 4).alias("exposure_after"))


def hedge_targets(spark, sf):
    h = _held(fixtures.quotes(spark, sf)).filter("strike = 10000")
    held = h.select(
        "day", "timestamp", "spot", "strike", "tte", (F.col("event_id") % 21 - 8).alias("option_position"), (F.col("event_id") % 13 - 6).alias("spot_position"),
        (F.col("event_id") % 5).alias("option_ask_volume"), (F.col("event_id") % 7).alias("spot_bid_volume"), (F.col("event_id") % 9).alias("spot_ask_volume"),
    )
    return signals.hedge_targets(held)


QUERIES = (
    level_stats, outer_vs_mid, two_layer_value, touch_spread, volume_templates, tier_sizes, quote_prices, reversion_signal, trend_loader, outer_quotes,
    tier_fires, informed_filter, basket_within, basket_cross, basket_residual, best_member, family_corr, family_corr_mean, lead_lag, lead_lag_boot,
    lead_lag_summary, pair_match, pair_diagnostics, pair_signal, basket_signal, tape_validation, bs_price_delta_vega, implied_vol, smile,
    expiry_calibration, calibrated_expiry, expiry_by_strike, expiry_scan, scanned_expiry, scanned_expiry_by_strike, iv_trend, iv_reversion, single_edges, pair_edges, level_regression, iv_signal,
    net_exposure, exposure_excursion, exposure_cap, hedge_targets,
)

# ------------------------------------------------------------------------------------------ SQL

BK = f"""WITH bl AS ({BOOK_LEVELS}), tp AS (SELECT day, product, order_id * 100 AS timestamp, count(bid_price) AS nb, count(ask_price) AS na, max(bid_price) AS bid, min(ask_price) AS ask,
 arg_max(bid_price, bid_volume * 1000000 + bid_price) AS ob, arg_max(ask_price, ask_volume * 1000000 - ask_price) AS oa, max(CASE WHEN level = 1 THEN bid_price END) AS b1, max(CASE WHEN level = 1 THEN ask_price END) AS a1,
 max(CASE WHEN level = 1 THEN bid_volume END) AS bv1, max(CASE WHEN level = 1 THEN ask_volume END) AS av1 FROM bl GROUP BY day, product, order_id),
u AS (SELECT *, (bid + ask) / 2.0 AS mid, (ob + oa) / 2.0 AS anchor FROM tp WHERE nb > 0 AND na > 0)"""
FAIR = "CASE WHEN abs(mid - anchor) <= 2.0 THEN (anchor + mid) / 2.0 ELSE anchor END"


def _z(src: str, value: str, w: int, keys: str = "day, product", extra: str = "") -> str:
    return f"""zz AS (SELECT *, count(*) OVER w AS wn, avg({value}) OVER w AS wm, stddev_pop({value}) OVER w AS ws FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY timestamp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)),
z AS (SELECT *, ({value} - wm) / ws AS z FROM zz WHERE wn = {w} AND ws > 0)"""


SIZE = "CASE WHEN {d} >= 2.0 THEN 20 WHEN {d} >= 1.5 THEN 10 WHEN {d} >= 1.0 THEN 5 ELSE 0 END"
BUY_Q = "greatest(CASE WHEN {b} + 1 >= {a} THEN {a} - 1 ELSE {b} + 1 END, {b})"
SELL_Q = "least(CASE WHEN {a} - 1 <= {b} THEN {b} + 1 ELSE {a} - 1 END, {a})"


def _decide(target: str, extreme: float, keys: str, zround: int = 6) -> str:
    """From z with z, bid, ask: intents."""
    return f"""d AS (SELECT *, CASE WHEN z > 0 THEN 'sell' ELSE 'buy' END AS side, {SIZE.format(d='abs(z)')} AS size, abs(z) >= {extreme} AS hard FROM z),
p AS (SELECT *, CASE WHEN hard THEN CASE WHEN side = 'buy' AND ({target}) - ask >= 0 THEN ask WHEN side = 'sell' AND bid - ({target}) >= 0 THEN bid END
 WHEN bid < ask THEN CASE WHEN side = 'buy' THEN {BUY_Q.format(b='bid', a='ask')} ELSE {SELL_Q.format(b='bid', a='ask')} END END AS price FROM d WHERE size > 0)
SELECT {keys}, side, CAST(CASE WHEN side = 'buy' THEN size ELSE -size END AS BIGINT) AS quantity, CAST(price AS BIGINT) AS price, CASE WHEN hard THEN 'aggressive' ELSE 'passive' END AS mechanism, round(z, {zround}) AS z FROM p WHERE price IS NOT NULL"""


PN = f"WITH panel AS ({PANEL})"
OTH = f"{PN}, o AS (SELECT *, sum(mid_price) OVER (PARTITION BY day, timestamp, family) - mid_price AS others FROM panel)"
REG = "CASE WHEN max(mid_price) - min(mid_price) < 0.001 OR max({x}) - min({x}) < 0.001 THEN 0.0 ELSE least(1.0, regr_r2(mid_price, {x})) END"
CH = f"{PN}, ch AS (SELECT *, mid_price - lag(mid_price) OVER (PARTITION BY day, product ORDER BY timestamp) AS change FROM panel), c AS (SELECT *, row_number() OVER (PARTITION BY day, product ORDER BY timestamp) - 1 AS i FROM ch WHERE change IS NOT NULL)"
LL = f"""{CH}, ls AS (SELECT x.family, x.product AS leader, y.product AS follower, k.lag, x.day, count(*) AS n, sum(x.change) AS sx, sum(y.change) AS sy, sum(x.change * x.change) AS sxx, sum(y.change * y.change) AS syy, sum(x.change * y.change) AS sxy
 FROM c x, (SELECT unnest({LAGS}) AS lag) k, c y WHERE y.day = x.day AND y.family = x.family AND y.i = x.i + k.lag AND y.product <> x.product GROUP BY ALL)"""
C0 = "coalesce(CASE WHEN n >= 2 AND n * sxx - sx * sx > 1e-12 * n * sxx AND n * syy - sy * sy > 1e-12 * n * syy THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) END, 0.0)"
PEAK = f""", lc AS (SELECT family, leader, follower, lag, {C0} AS corr FROM (SELECT family, leader, follower, lag, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM ls GROUP BY ALL) q),
pk AS (SELECT family, leader, follower, lag AS peak_lag, corr AS peak FROM (SELECT *, row_number() OVER (PARTITION BY family, leader, follower ORDER BY round(abs(corr), 12) DESC, lag) AS rn FROM lc) q WHERE rn = 1)"""
BOOT = f"""{DAYS.format(src="ls")}, bv AS (SELECT family, leader, follower, r, peak AS est, {C0} AS v FROM (SELECT pk.family, pk.leader, pk.follower, r, peak, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy
 FROM pk JOIN ls ON ls.family = pk.family AND ls.leader = pk.leader AND ls.follower = pk.follower AND ls.lag = pk.peak_lag JOIN dr ON dr.day = ls.day GROUP BY ALL) q),
ci AS (SELECT family, leader, follower, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, {P_OF} AS p, {FLOORED} AS floored FROM bv GROUP BY family, leader, follower)"""

# the price of a call, from the same polynomial
_N = "(CASE WHEN {x} >= 0 THEN {u} ELSE 1.0 - {u} END)"


def _cdf(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {z}))"
    poly = f"((((({1.061405429} * {t} + {-1.453152027}) * {t} + {1.421413741}) * {t} + {-0.284496736}) * {t} + {0.254829592}) * {t})"
    u = f"(0.5 * (1.0 + (1.0 - {poly} * exp(-{z} * {z}))))"
    return _N.format(x=x, u=u)


def _d1(vol: str, tte: str = "tte") -> str:
    return f"((ln(spot / strike) + (0.0 + {vol} * {vol} / 2.0) * {tte}) / ({vol} * sqrt({tte})))"


def _call(vol: str, tte: str = "tte") -> str:
    return f"(spot * {_cdf(_d1(vol, tte))} - strike * {_cdf(f'({_d1(vol, tte)} - {vol} * sqrt({tte}))')})"


QT = f"""WITH RECURSIVE ticks AS ({TICKS}), qi AS ({QUOTE_INPUTS}), qx AS (SELECT day, timestamp, event_id, spot, CAST(strike AS DOUBLE) AS strike, tte, true_vol, below_intrinsic FROM qi),
qq AS (SELECT *, CASE WHEN below_intrinsic THEN greatest(spot - strike, 0.0) - 0.5 WHEN tte > 0 THEN {_call('true_vol')} END AS price FROM qx)"""


def _bisect(src: str, keys: str) -> str:
    """iv: rows of src before expiry with iv by 23 halvings, where 1e-6 and 5 bracket the price."""
    return f"""bi AS (SELECT {keys}, spot, strike, tte, price, 0 AS k, CAST(0.000001 AS DOUBLE) AS lo, CAST(5.0 AS DOUBLE) AS hi FROM {src} WHERE tte > 0 AND {_call('0.000001')} <= price AND {_call('5.0')} >= price
 UNION ALL SELECT {keys}, spot, strike, tte, price, k + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (SELECT *, {_call('mid')} < price AS below FROM (SELECT *, (lo + hi) / 2.0 AS mid FROM bi WHERE k < 23) a) b),
iv AS (SELECT {keys}, spot, strike, tte, price, (lo + hi) / 2.0 AS iv FROM bi WHERE k = 23)"""


IV = f"{QT}, {_bisect('qq', 'day, timestamp, event_id')}"
VEGA = lambda vol: f"(spot * (exp(-{_d1(vol)} * {_d1(vol)} / 2.0) / sqrt(2.0 * pi())) * sqrt(tte))"
#: One solve a quote, by halvings: the least (lo, hi) and the greatest (lp, hp) total deviation of the price. At each expiry then a
#: division, where the volatilities 1e-6 and 5 bracket the price.
_W = lambda w: _call(w, "1.0")
_ENDS = [f"CAST({x!r} AS DOUBLE)" for x in (pricing.LEAST_DEVIATION, pricing.MOST_DEVIATION)]
SOLVED = f"""{QT}, di AS (SELECT day, timestamp, spot, strike, price, 0 AS k, {_ENDS[0]} AS lo, {_ENDS[1]} AS hi, {_ENDS[0]} AS lp, {_ENDS[1]} AS hp FROM qq WHERE {_W(_ENDS[0])} <= price AND {_W(_ENDS[1])} >= price
 UNION ALL SELECT day, timestamp, spot, strike, price, k + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, CASE WHEN upto THEN mip ELSE lp END, CASE WHEN upto THEN hp ELSE mip END
 FROM (SELECT *, {_W('mid')} < price AS below, {_W('mip')} <= price AS upto FROM (SELECT *, (lo + hi) / 2.0 AS mid, (lp + hp) / 2.0 AS mip FROM di WHERE k < {pricing.HALVINGS}) a) b),
dv AS MATERIALIZED (SELECT day, timestamp, strike, (lo + hi) / 2.0 AS w, (lp + hp) / 2.0 AS wp FROM di WHERE k = {pricing.HALVINGS})"""
_AT = "(SELECT day, strike, expiry, greatest(w / sqrt(tte), 0.000001) AS iv FROM (SELECT dv.*, x.e AS expiry, x.e - day - timestamp / 1000000.0 AS tte FROM dv, ({}) x) a WHERE tte > 0 AND 0.000001 * sqrt(tte) <= wp AND 5.0 * sqrt(tte) >= w)"
EXP = f"{SOLVED}, iv AS {_AT.format(f'SELECT unnest({EXPIRIES}) AS e')}"
_SCORES = "SELECT expiry, (max(m) - min(m)) / avg(m) AS d FROM (SELECT expiry, day, avg(iv) AS m FROM {}iv GROUP BY ALL) m GROUP BY expiry HAVING count(*) = (SELECT count(DISTINCT day) FROM qq)"
SCAN = f"""{SOLVED}, civ AS {_AT.format(f"SELECT unnest({options.COARSE}) AS e")}, cs AS ({_SCORES.format("c")}), best AS (SELECT expiry AS b FROM cs ORDER BY round(d, 12), expiry LIMIT 1),
fiv AS {_AT.format("SELECT b - CAST(0.75 AS DOUBLE) + CAST(0.05 AS DOUBLE) * i AS e FROM best, (SELECT unnest(range(0, 31)) AS i) r")}, fs AS ({_SCORES.format("f")})"""


def _h(quoted: str, src: str) -> str:
    return f"""{QT}, h AS (SELECT day, timestamp, CAST(strike AS INTEGER) AS strike, spot, tte, price, event_id, CAST((event_id + CAST(strike AS BIGINT) // 100) % 41 - 20 AS BIGINT) AS position, CASE WHEN {quoted} THEN {_cdf(_d1('true_vol'))} END AS delta FROM {src}),
ne AS (SELECT day, timestamp, sum(position * coalesce(delta, 0)) AS exposure FROM h GROUP BY ALL)"""


HELD = _h("NOT below_intrinsic", "qq WHERE tte > 0")
#: Every tick; options at or past expiry have no delta.
HELD_ALL = _h("NOT below_intrinsic AND tte > 0", "qq")

SQL = {
    "level_stats": f"""{BK} SELECT day, product, l.level, round(avg(CASE WHEN b.bid_price IS NULL THEN 0.0 ELSE 1.0 END), 6) AS bid_presence, round(avg(CASE WHEN b.ask_price IS NULL THEN 0.0 ELSE 1.0 END), 6) AS ask_presence, round(avg(b.bid_volume), 6) AS bid_volume, round(avg(b.ask_volume), 6) AS ask_volume
FROM (SELECT DISTINCT day, product, order_id FROM bl) o CROSS JOIN (SELECT unnest([1, 2, 3]) AS level) l LEFT JOIN bl b USING (day, product, order_id, level) GROUP BY ALL""",
    "outer_vs_mid": f"""{BK}, x AS (SELECT day, product, CASE WHEN nb > 0 AND na > 0 THEN abs((ob + oa) / 2.0 - (bid + ask) / 2.0) END AS apart FROM tp)
SELECT day, product, count(apart) AS usable, count(*) AS ticks, round(coalesce(avg(apart), 0), 6) AS mean_apart, round(coalesce(median(apart), 0), 6) AS median_apart, round(coalesce(max(apart), 0), 6) AS max_apart, round(coalesce(avg(CASE WHEN apart IS NULL THEN NULL WHEN apart > 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS share_apart FROM x GROUP BY day, product""",
    "two_layer_value": f"{BK} SELECT day, product, timestamp, round({FAIR}, 6) AS fair FROM u",
    "touch_spread": f"{BK} SELECT day, product, count(a1 - b1) AS n_spread, round(avg(a1 - b1), 6) AS mean_spread, round(median(a1 - b1), 6) AS median_spread FROM tp GROUP BY day, product",
    "volume_templates": f"""{BK}, s AS (SELECT product, string_agg(day || ':' || timestamp || ':' || coalesce(CAST(bv1 AS VARCHAR), '-') || ':' || coalesce(CAST(av1 AS VARCHAR), '-'), ',' ORDER BY day, timestamp) AS h FROM tp GROUP BY product)
SELECT product, min(product) OVER (PARTITION BY h) AS template, count(*) OVER (PARTITION BY h) AS products FROM s""",
    "tier_sizes": f"""{BK}, x AS (SELECT day, product, timestamp, abs(mid - 10050.0) / 20.0 AS dev, CASE WHEN timestamp % 200 = 0 THEN 'buy' ELSE 'sell' END AS side, (timestamp // 100) % 101 - 50 AS held FROM u),
y AS (SELECT *, least({SIZE.format(d='dev')}, greatest(0, CASE WHEN side = 'buy' THEN 50 - held ELSE held + 50 END)) AS size FROM x)
SELECT day, product, timestamp, CAST(size AS BIGINT) AS size, CAST(least(size, floor(greatest(0.0, 25.0 - held / 2.0))) AS BIGINT) AS capped FROM y""",
    "quote_prices": f"""{BK} SELECT day, product, timestamp, CASE WHEN bid < ask THEN {BUY_Q.format(b='bid', a='ask')} END AS buy, CASE WHEN bid < ask THEN {SELL_Q.format(b='bid', a='ask')} END AS sell, CAST(round_even(mid, 0) AS BIGINT) AS mid_price FROM u""",
    "reversion_signal": f"{BK}, {_z('u', 'mid', W)}, {_decide('wm', EXTREME, 'day, product, timestamp')}",
    "trend_loader": f"""{BK}, f0 AS (SELECT *, first_value(mid) OVER w + 0.001 * (timestamp - first_value(timestamp) OVER w) AS fair FROM u WINDOW w AS (PARTITION BY day, product ORDER BY timestamp)),
f1 AS (SELECT *, bool_or(abs(mid - fair) > 200.0) OVER (PARTITION BY day, product ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS halted FROM f0),
t AS (SELECT f1.day, f1.product, f1.timestamp, fair, ask_price AS price, ask_volume AS v, coalesce(sum(ask_volume) OVER (PARTITION BY f1.day, f1.product, f1.timestamp ORDER BY ask_price, ask_volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM f1 JOIN bl ON bl.day = f1.day AND bl.product = f1.product AND bl.order_id * 100 = f1.timestamp WHERE NOT halted AND ask_price <= fair + 5.0)
SELECT day, product, timestamp, price, CAST(least(v, greatest(50 - before, 0)) AS BIGINT) AS quantity, round(fair, 6) AS fair FROM t WHERE least(v, greatest(50 - before, 0)) > 0""",
    "outer_quotes": f"""{BK} SELECT day, product, timestamp, side, CAST(CASE WHEN side = 'buy' THEN 3 ELSE -3 END AS BIGINT) AS quantity, CASE WHEN side = 'buy' THEN {BUY_Q.format(b='bid', a='ask')} ELSE {SELL_Q.format(b='bid', a='ask')} END AS price FROM u, (SELECT unnest(['buy', 'sell']) AS side) s WHERE bid < ask""",
    "tier_fires": f"""{BK}, v AS (SELECT day, product, timestamp, {FAIR} AS fair FROM u), {_z('v', 'fair', W)}, t AS (SELECT product, abs(fair - wm) AS d, CASE WHEN abs(z) >= 2.0 THEN 3 WHEN abs(z) >= 1.5 THEN 2 WHEN abs(z) >= 1.0 THEN 1 ELSE 0 END AS tier FROM z)
SELECT product, tier, count(*) AS fires, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.1), 6) AS p10, round(median(d), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90 FROM t WHERE tier > 0 GROUP BY product, tier""",
    "informed_filter": f"""WITH ticks AS ({TICKS}), trades AS ({TRADES}), c AS (SELECT * FROM ticks WHERE mid_price > 0), {_z('c', 'mid_price', W)},
i AS (SELECT day, symbol AS product, timestamp, CASE WHEN seller IN ('U1', 'U2') THEN -1 ELSE 1 END AS way FROM trades WHERE buyer IN ('U1', 'U2') OR seller IN ('U1', 'U2')),
x AS (SELECT day, product, timestamp, CASE WHEN z > 0 THEN 'sell' ELSE 'buy' END AS side, CASE WHEN abs(z) >= 1.5 THEN 'aggressive' ELSE 'passive' END AS mechanism FROM z WHERE abs(z) >= 1.0),
m AS (SELECT x.*, CASE WHEN x.timestamp - i.timestamp <= 500 THEN way END AS way FROM x ASOF LEFT JOIN i ON x.day = i.day AND x.product = i.product AND x.timestamp >= i.timestamp)
SELECT day, product, timestamp, side, mechanism FROM m WHERE NOT coalesce(mechanism = 'aggressive' AND way = CASE WHEN side = 'buy' THEN -1 ELSE 1 END, false)""",
    "basket_within": f"""{OTH}, d AS (SELECT family, product, day, {REG.format(x='others')} AS r2 FROM o GROUP BY ALL), a AS (SELECT family, product, count(*) AS n, regr_slope(mid_price, others) AS slope, regr_intercept(mid_price, others) AS icept, {REG.format(x='others')} AS r2 FROM o GROUP BY ALL)
SELECT a.family, a.product, a.n, round(slope, 6) AS slope, round(a.r2, 6) AS r2, round(m, 6) AS min_day_r2, round(icept, 2) AS intercept, a.r2 >= 0.999 AND m >= 0.999 AS identity FROM a JOIN (SELECT family, product, min(r2) AS m FROM d GROUP BY ALL) e ON e.family = a.family AND e.product = a.product""",
    "basket_cross": f"""{PN}, t AS (SELECT day, timestamp, family AS other, sum(mid_price) AS total FROM panel GROUP BY ALL), o AS (SELECT panel.*, other, total FROM panel JOIN t USING (day, timestamp) WHERE family <> other),
d AS (SELECT family, product, other, day, CASE WHEN max(total) - min(total) < 0.001 THEN 0 ELSE {REG.format(x='total')} END AS r2 FROM o GROUP BY ALL),
a AS (SELECT family, product, other, count(*) AS n, CASE WHEN max(total) - min(total) < 0.001 THEN 0 ELSE regr_slope(mid_price, total) END AS slope, CASE WHEN max(total) - min(total) < 0.001 THEN 0 ELSE {REG.format(x='total')} END AS r2 FROM o GROUP BY ALL)
SELECT a.family, a.product, a.other, a.n, round(slope, 6) AS slope, round(a.r2, 6) AS r2, round(m, 6) AS min_day_r2, a.r2 >= 0.999 AND m >= 0.999 AS identity FROM a JOIN (SELECT family, product, other, min(r2) AS m FROM d GROUP BY ALL) e ON e.family = a.family AND e.product = a.product AND e.other = a.other""",
    "basket_residual": f"""{PN}, r AS (SELECT day, timestamp, family, sum(mid_price) - 5000000.0 AS r FROM panel GROUP BY ALL) SELECT day, family, count(*) AS n, round(stddev_pop(r), 2) AS std, round(quantile_cont(abs(r), 0.9), 4) AS p90, round(quantile_cont(abs(r), 0.99), 4) AS p99 FROM r GROUP BY day, family""",
    "best_member": f"""{OTH}, a AS (SELECT family, product, {REG.format(x='others')} AS r2 FROM o GROUP BY ALL) SELECT family, arg_max(product, round(r2, 9) * 1000000 + product / 1000000.0) AS product, round(max(r2), 6) AS r2 FROM a GROUP BY family""",
    "family_corr": f"""{CH}, s AS (SELECT x.day, x.family, x.product AS a, y.product AS b, count(*) AS n, sum(x.change) AS sx, sum(y.change) AS sy, sum(x.change * x.change) AS sxx, sum(y.change * y.change) AS syy, sum(x.change * y.change) AS sxy FROM c x JOIN c y ON y.day = x.day AND y.family = x.family AND y.i = x.i GROUP BY ALL)
SELECT day, family, a, b, round(CASE WHEN a = b THEN 1.0 ELSE {C0} END, 6) AS corr FROM s""",
    "family_corr_mean": f"""{CH}, s AS (SELECT x.day, x.family, x.product AS a, y.product AS b, count(*) AS n, sum(x.change) AS sx, sum(y.change) AS sy, sum(x.change * x.change) AS sxx, sum(y.change * y.change) AS syy, sum(x.change * y.change) AS sxy FROM c x JOIN c y ON y.day = x.day AND y.family = x.family AND y.i = x.i WHERE x.product <> y.product GROUP BY ALL)
SELECT day, family, count(*) AS pairs, round(avg({C0}), 6) AS mean_corr, round(avg(abs({C0})), 6) AS mean_abs_corr FROM s GROUP BY day, family""",
    "lead_lag": f"{LL}{PEAK} SELECT family, leader, follower, peak_lag, round(peak, 6) AS peak FROM pk",
    "lead_lag_boot": f"{LL}{PEAK}{BOOT} SELECT family, leader, follower, peak_lag, round(peak, 6) AS peak, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p, floored FROM pk JOIN ci USING (family, leader, follower)",
    "lead_lag_summary": f"{LL}{PEAK}{BOOT} SELECT family, count(*) AS pairs, CAST(sum(CASE WHEN peak_lag <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS off_zero, CAST(sum(CASE WHEN lo > 0 OR hi < 0 THEN 1 ELSE 0 END) AS BIGINT) AS significant FROM pk JOIN ci USING (family, leader, follower) GROUP BY family",
    "pair_match": f"""{LL}, e AS (SELECT family, leader AS a, follower AS b, {C0} AS weight FROM (SELECT family, leader, follower, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM ls WHERE lag = 0 AND leader < follower GROUP BY ALL) q),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(abs(weight), 9) DESC, a, b) AS rn FROM e) q WHERE rn = 1),
g AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.family ORDER BY round(abs(e.weight), 9) DESC, e.a, e.b) AS rn FROM e JOIN f ON f.family = e.family WHERE e.a NOT IN (f.a, f.b) AND e.b NOT IN (f.a, f.b)) q WHERE rn = 1)
SELECT family, a, b, round(weight, 6) AS weight FROM (SELECT * FROM f UNION ALL SELECT * FROM g) q""",
    "pair_diagnostics": f"""{PN}, s AS (SELECT x.day, x.timestamp, x.mid_price - y.mid_price AS v, row_number() OVER (PARTITION BY x.day ORDER BY x.timestamp) - 1 AS i, count(*) OVER (PARTITION BY x.day) AS n FROM panel x JOIN panel y ON y.day = x.day AND y.timestamp = x.timestamp WHERE x.product = 5 AND y.product = 6),
l AS (SELECT day, v, lag(v) OVER (PARTITION BY day ORDER BY i) AS p, avg(v) OVER (PARTITION BY day) AS m FROM s), a AS (SELECT day, regr_slope(v - m, p - m) AS phi FROM l GROUP BY day),
sz AS (SELECT DISTINCT day, n FROM s), p AS (SELECT day, n, r, b, {_draw('n', 'r', 'b')} AS st FROM sz, (SELECT unnest(range(0, {REPS})) AS r) q, LATERAL (SELECT unnest(range(0, CAST(ceil(n / 3.0) AS BIGINT))) AS b) w),
e AS (SELECT day, r, b * 3 + k AS pos, (st + k) % n AS i FROM p, (SELECT unnest(range(0, 3)) AS k) q WHERE b * 3 + k < n), f AS (SELECT day, min(v) AS base FROM s GROUP BY day),
rr AS (SELECT e.day, r, coalesce(CASE WHEN stddev_pop(v - base) > 1e-6 THEN regr_r2(v - base, pos) END, 0) AS r2 FROM e JOIN s ON s.day = e.day AND s.i = e.i JOIN f ON f.day = e.day GROUP BY e.day, r),
o AS (SELECT s.day, regr_r2(v - base, i) AS own FROM s JOIN f ON f.day = s.day GROUP BY s.day), t AS (SELECT o.day, (sum(CASE WHEN r2 >= own THEN 1 ELSE 0 END) + 1) / {REPS + 1}.0 AS p FROM rr JOIN o ON o.day = rr.day GROUP BY o.day),
w AS (SELECT day, median(sd) AS rs FROM (SELECT day, count(*) OVER q AS wn, stddev_pop(v) OVER q AS sd FROM s WINDOW q AS (PARTITION BY day ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) x WHERE wn = 5 AND sd > 0 GROUP BY day)
SELECT a.day, round(phi, 6) AS phi, round(t.p, 6) AS trend_p, 5.0 AS round_trip_cost, round(CASE WHEN abs(phi) < 1 THEN ln(2.0) / -ln(abs(phi)) END, 4) AS half_life, round(rs, 2) AS rolling_std, round(rs / 5.0, 2) AS amplitude_over_cost FROM a LEFT JOIN t USING (day) LEFT JOIN w USING (day)""",
    "pair_signal": f"""{PN}, b AS (SELECT *, CAST(round(mid_price) AS BIGINT) - 2 AS bid, CAST(round(mid_price) AS BIGINT) + 3 AS ask FROM panel),
s AS (SELECT x.day, x.timestamp, x.mid_price - y.mid_price AS v, x.mid_price AS ma, y.mid_price AS mb, x.bid AS ba, x.ask AS aa, y.bid AS bb, y.ask AS ab FROM b x JOIN b y ON y.day = x.day AND y.timestamp = x.timestamp WHERE x.product = 5 AND y.product = 6), {_z('s', 'v', 5, 'day')},
d AS (SELECT *, {SIZE.format(d='abs(z)')} AS size, abs(z) >= {EXTREME} AS hard, mb + wm AS fa, ma - wm AS fb FROM z),
p AS (SELECT *, CASE WHEN hard THEN CASE WHEN z > 0 AND ba - fa >= 0 THEN ba WHEN NOT z > 0 AND fa - aa >= 0 THEN aa END WHEN z > 0 THEN {SELL_Q.format(b='ba', a='aa')} ELSE {BUY_Q.format(b='ba', a='aa')} END AS pa,
 CASE WHEN hard THEN CASE WHEN z > 0 AND fb - ab >= 0 THEN ab WHEN NOT z > 0 AND bb - fb >= 0 THEN bb END WHEN z > 0 THEN {BUY_Q.format(b='bb', a='ab')} ELSE {SELL_Q.format(b='bb', a='ab')} END AS pb FROM d WHERE size > 0)
SELECT day, CASE WHEN l = 'a' THEN 5 ELSE 6 END AS product, timestamp, CASE WHEN (z > 0) = (l = 'a') THEN 'sell' ELSE 'buy' END AS side, CAST(CASE WHEN (z > 0) = (l = 'a') THEN -size ELSE size END AS BIGINT) AS quantity, CASE WHEN l = 'a' THEN pa ELSE pb END AS price, CASE WHEN hard THEN 'aggressive' ELSE 'passive' END AS mechanism, round(z, 6) AS z
FROM p, (SELECT unnest(['a', 'b']) AS l) q WHERE pa IS NOT NULL AND pb IS NOT NULL""",
    "basket_signal": f"""{PN}, b AS (SELECT *, CAST(round(mid_price) AS BIGINT) - 2 AS bid, CAST(round(mid_price) AS BIGINT) + 3 AS ask, 5000000.0 - (sum(mid_price) OVER (PARTITION BY day, timestamp, family) - mid_price) AS fair FROM panel WHERE family <> 0),
v AS (SELECT *, mid_price - fair AS dev FROM b), {_z('v', 'dev', 5)}, {_decide('fair + wm', EXTREME, 'day, product, timestamp')}""",
    "tape_validation": f"""{PN} SELECT day, CAST(count(*) AS BIGINT) AS ticks, count(DISTINCT product) AS products, CAST((SELECT count(DISTINCT product) FROM panel) - count(DISTINCT product) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unaligned FROM panel GROUP BY day""",
    "bs_price_delta_vega": f"{QT} SELECT day, timestamp, CAST(strike AS INTEGER) AS strike, CASE WHEN tte > 0 THEN round({_call('true_vol')}, 6) END AS price, CASE WHEN tte > 0 THEN round({_cdf(_d1('true_vol'))}, 6) END AS delta, CASE WHEN tte > 0 THEN round({VEGA('true_vol')}, 6) END AS vega FROM qq",
    "implied_vol": f"{IV} SELECT qq.day, qq.timestamp, CAST(qq.strike AS INTEGER) AS strike, round(iv.iv, 5) AS iv FROM qq LEFT JOIN iv ON iv.event_id = qq.event_id AND iv.strike = qq.strike WHERE qq.tte > 0",
    "smile": f"""{IV}, a AS (SELECT qq.day, qq.strike, iv.iv FROM qq LEFT JOIN iv ON iv.event_id = qq.event_id AND iv.strike = qq.strike WHERE qq.tte > 0) SELECT day, CAST(strike AS INTEGER) AS strike, count(iv) AS n, count(*) - count(iv) AS skipped, round(avg(iv), 6) AS mean_iv, round(stddev_pop(iv), 6) AS std_iv FROM a GROUP BY day, strike""",
    "expiry_scan": f"""{SCAN} SELECT 'coarse' AS scan, round(CAST(expiry AS DOUBLE), 6) AS expiry, round(d, 6) AS dispersion FROM cs UNION ALL SELECT 'fine', round(expiry, 6), round(d, 6) FROM fs""",
    "scanned_expiry": f"""{SCAN} SELECT round(expiry, 6) AS expiry, round(d, 6) AS dispersion FROM fs ORDER BY round(d, 12), expiry LIMIT 1""",
    "scanned_expiry_by_strike": f"""{SCAN}, ms AS (SELECT strike, expiry, day, avg(iv) AS m FROM fiv GROUP BY ALL), s AS (SELECT strike, expiry, (max(m) - min(m)) / avg(m) AS d FROM ms GROUP BY strike, expiry HAVING count(*) = (SELECT count(DISTINCT day) FROM qq))
SELECT CAST(strike AS INTEGER) AS strike, round(expiry, 6) AS expiry, round(d, 6) AS dispersion FROM (SELECT *, row_number() OVER (PARTITION BY strike ORDER BY round(d, 12), expiry) AS rn FROM s) q WHERE rn = 1""",
    "expiry_calibration": f"""{EXP}, m AS (SELECT expiry, day, avg(iv) AS m FROM iv GROUP BY ALL) SELECT CAST(expiry AS DOUBLE) AS expiry, round((max(m) - min(m)) / avg(m), 6) AS dispersion FROM m GROUP BY expiry HAVING count(*) = 3""",
    "calibrated_expiry": f"""{EXP}, m AS (SELECT expiry, day, avg(iv) AS m FROM iv GROUP BY ALL), s AS (SELECT expiry, (max(m) - min(m)) / avg(m) AS d FROM m GROUP BY expiry HAVING count(*) = 3) SELECT CAST(expiry AS DOUBLE) AS expiry, round(d, 6) AS dispersion FROM s ORDER BY round(d, 12), expiry LIMIT 1""",
    "expiry_by_strike": f"""{EXP}, m AS (SELECT strike, expiry, day, avg(iv) AS m FROM iv GROUP BY ALL), s AS (SELECT strike, expiry, (max(m) - min(m)) / avg(m) AS d FROM m GROUP BY strike, expiry HAVING count(*) = 3)
SELECT CAST(strike AS INTEGER) AS strike, CAST(expiry AS DOUBLE) AS expiry, round(d, 6) AS dispersion FROM (SELECT *, row_number() OVER (PARTITION BY strike ORDER BY round(d, 12), expiry) AS rn FROM s) q WHERE rn = 1""",
    "iv_trend": f"{IV} SELECT day, CAST(strike AS INTEGER) AS strike, count(*) AS n, round(abs(regr_slope(iv, timestamp)) / avg(iv) * 1e6, 4) AS per_million FROM iv GROUP BY day, strike",
    "iv_reversion": f"""{IV}, l AS (SELECT day, strike, iv, lag(iv) OVER (PARTITION BY day, strike ORDER BY timestamp) AS p FROM iv) SELECT day, CAST(strike AS INTEGER) AS strike, count(*) AS n, 'ok' AS status, round(regr_slope(iv, p), 5) AS phi FROM l GROUP BY day, strike""",
    "single_edges": f"""{IV}, r AS (SELECT *, row_number() OVER (PARTITION BY day, strike ORDER BY timestamp) - 1 AS rn FROM iv), v AS (SELECT day, strike, avg({VEGA('iv')}) AS vega FROM r WHERE rn % 50 = 0 GROUP BY day, strike), s AS (SELECT day, strike, count(*) AS n, stddev_pop(iv) AS sd FROM iv GROUP BY day, strike)
SELECT day, CAST(strike AS INTEGER) AS strike, n, round(vega, 3) AS vega, round(sd * vega, 4) AS price_std, round(1.0 + (strike - 9700) / 200.0, 6) AS mean_spread, round((1.0 + (strike - 9700) / 200.0) / (sd * vega), 4) AS breakeven_z FROM s JOIN v USING (day, strike) WHERE n >= 3""",
    "pair_edges": f"""{IV}, w AS (SELECT day, timestamp, spot, strike, tte, CASE WHEN CAST(strike AS BIGINT) % 200 = 0 THEN iv * 1.25 ELSE iv END AS iv FROM iv), g AS (SELECT a.day, a.timestamp, a.spot, a.strike, b.strike AS above, a.tte, a.iv AS i1, b.iv AS i2, row_number() OVER (PARTITION BY a.day, a.strike ORDER BY a.timestamp) - 1 AS rn FROM w a JOIN w b ON b.day = a.day AND b.timestamp = a.timestamp AND b.strike = a.strike + 100),
v1 AS (SELECT day, strike, rn, {VEGA('i1')} AS a FROM g), v2 AS (SELECT day, low AS strike, rn, {VEGA('i2')} AS b FROM (SELECT day, spot, strike AS low, above AS strike, tte, i2, rn FROM g) q), v AS (SELECT day, strike, avg((a + b) / 2.0) AS vega FROM v1 JOIN v2 USING (day, strike, rn) WHERE rn % 50 = 0 GROUP BY day, strike),
s AS (SELECT day, strike, above, count(*) AS n, stddev_pop(i2 - i1) AS sd FROM g GROUP BY ALL), c AS (SELECT *, (1.0 + (strike - 9700) / 200.0) + (1.0 + (above - 9700) / 200.0) AS cost FROM s)
SELECT day, CAST(strike AS INTEGER) AS strike, CAST(above AS INTEGER) AS above, n, round(vega, 3) AS vega, round(sd * vega, 4) AS price_std, round(cost, 6) AS cost, round(cost / (sd * vega), 4) AS breakeven_z FROM c JOIN v USING (day, strike)""",
    "level_regression": f"{QT} SELECT day, CAST(strike AS INTEGER) AS strike, count(price) AS n, round(corr(price, spot), 6) AS corr, round(regr_slope(price, spot), 6) AS slope, round(regr_r2(price, spot), 6) AS r2 FROM qq GROUP BY day, strike",
    "net_exposure": f"{HELD} SELECT day, timestamp, round(exposure, 6) AS exposure FROM ne",
    "exposure_excursion": f"{HELD_ALL} SELECT day, count(*) AS ticks, CAST(sum(CASE WHEN abs(exposure) > 0.9 * 60.0 THEN 1 ELSE 0 END) AS BIGINT) AS ticks_over, round(max(abs(exposure)), 6) AS max_exposure FROM ne GROUP BY day",
    "hedge_targets": f"""{HELD_ALL}, x AS (SELECT day, timestamp, event_id % 21 - 8 AS op, event_id % 13 - 6 AS sp, event_id % 5 AS ov, event_id % 7 AS bv, event_id % 9 AS av, spot, CAST(strike AS DOUBLE) AS strike, tte FROM h WHERE strike = 10000),
y AS (SELECT *, greatest(0, least(ov, 10 - op)) AS ob, CASE WHEN tte > 0 THEN {_cdf(_d1('0.012'))} END AS delta FROM x), w AS (SELECT *, greatest(-50 - sp, least(50 - sp, -round_even((op + ob) * delta, 0) - sp)) AS want FROM y)
SELECT day, timestamp, CAST(ob AS BIGINT) AS option_buy, CAST(CASE WHEN delta IS NULL THEN 0 WHEN want > 0 THEN least(want, av) WHEN want < 0 THEN -least(-want, bv) ELSE 0 END AS BIGINT) AS hedge FROM w""",
    "iv_signal": f"""{IV}, b AS (SELECT day, timestamp, strike, spot, tte, iv, CAST(round(price) AS BIGINT) - 1 AS bid, CAST(round(price) AS BIGINT) + 2 AS ask FROM iv), {_z('b', 'iv', W, 'day, strike')}, {_decide(_call('wm'), 1.4, 'day, timestamp, CAST(strike AS INTEGER) AS strike', 2)}""",
    "exposure_cap": f"""{HELD}, w AS (SELECT *, (event_id * 7 + strike // 100) % 31 - 15 AS quantity, CAST(round(price) AS BIGINT) AS px, row_number() OVER (PARTITION BY day, timestamp ORDER BY strike) AS k FROM h WHERE delta IS NOT NULL),
r AS (SELECT day, timestamp, CAST(0 AS BIGINT) AS k, exposure AS run, exposure AS e0, 0 AS strike, CAST(0 AS BIGINT) AS quantity, CAST(0 AS BIGINT) AS price, '' AS mechanism FROM ne
 UNION ALL SELECT day, timestamp, k, run + q * delta, e0, strike, q, CASE WHEN own <> 0 THEN px WHEN position > 0 THEN {SELL_Q.format(b='(px - 1)', a='(px + 2)')} ELSE {BUY_Q.format(b='(px - 1)', a='(px + 2)')} END, CASE WHEN own <> 0 THEN 'signal' ELSE 'reduce' END
 FROM (SELECT *, CASE WHEN own <> 0 THEN own WHEN abs(e0) >= 40.0 AND position <> 0 AND (position > 0) = (e0 > 0) THEN CASE WHEN position > 0 THEN -1 ELSE 1 END * least(5, abs(position)) ELSE 0 END AS q
  FROM (SELECT w.*, r.run, r.e0, CAST(CASE WHEN w.quantity = 0 OR delta <= 0 THEN 0 WHEN w.quantity > 0 THEN least(w.quantity, floor(greatest(0.0, 40.0 - run) / delta)) ELSE -least(-w.quantity, floor(greatest(0.0, 40.0 + run) / delta)) END AS BIGINT) AS own
   FROM r JOIN w ON w.day = r.day AND w.timestamp = r.timestamp AND w.k = r.k + 1) a) b),
l AS (SELECT day, timestamp, arg_max(run, k) AS ea FROM r GROUP BY day, timestamp)
SELECT r.day, r.timestamp, r.strike, r.quantity, r.price, r.mechanism, round(l.ea, 4) AS exposure_after FROM r JOIN l ON l.day = r.day AND l.timestamp = r.timestamp WHERE r.quantity <> 0""",
}
