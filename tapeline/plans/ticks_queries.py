"""Queries over ticks: indicators, regimes, flow, jumps; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators import attribution, bootstrap, flow, jumps, regime, series
from tapeline.operators.bootstrap import POISSON
from tapeline.plans import fixtures
from tapeline.plans.fixtures import TICKS, TRADES

W, DRIFT, LIMIT, REPS, SEED, BLOCK = 20, 50, 5.0, 200, 7, 10
HORIZONS, INFORMED, ACCOUNT = (1, 5, 10), ["U1", "U2"], "U0"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _clean(spark, sf) -> DataFrame:
    return series.clean_mids(fixtures.ticks(spark, sf))


def rolling_zscore(spark, sf):
    z = series.zscores(_clean(spark, sf), "mid_price", W).filter("z IS NOT NULL")
    return z.select("day", "product", "timestamp", *r6("z"))


def zscore_percentiles(spark, sf):
    return regime.z_percentiles(_clean(spark, sf), "mid_price", W).select("day", "product", "n", "percentile", *r6("abs_z"))


def loo_percentiles(spark, sf):
    return regime.leave_one_out_percentiles(_clean(spark, sf), "mid_price", W).select("product", "held_out", "n", "percentile", *r6("abs_z"))


def ema(spark, sf):
    return series.ema(_clean(spark, sf), "mid_price", 10).select("day", "product", "timestamp", *r6("ema"))


def lag_acf(spark, sf):
    acf = series.in_blocks(_clean(spark, sf), lambda rows, keys: series.lag_acf(rows, "mid_price", W, 3, keys), W + 3)
    return acf.filter("acf IS NOT NULL").select("day", "product", "timestamp", *r6("acf"))


def drift_monitor(spark, sf):
    return series.drift_monitor(_clean(spark, sf), "mid_price", DRIFT, LIMIT).select("day", "product", "timestamp", "drifting")


def drifting_fraction(spark, sf):
    return series.drifting_fraction(_clean(spark, sf), "mid_price", DRIFT, LIMIT).select("day", "product", "n", *r6("fraction"))


def drawdown_sharpe(spark, sf):
    t = _clean(spark, sf)
    return series.drawdown(t, "mid_price").join(series.sharpe(t, "mid_price"), ["day", "product"]).select("day", "product", *r6("max_drawdown", "sharpe"))


def ar1_fit(spark, sf):
    return regime.ar1(_clean(spark, sf), "mid_price").select("day", "product", "n", "status", *r6("phi"), F.round("half_life", 4).alias("half_life"), F.round("long_run_mean", 3).alias("long_run_mean"))


def linear_trend(spark, sf):
    fit = regime.linear_trend(_clean(spark, sf), "mid_price")
    return fit.select("day", "product", "n", F.round("slope_per_ts", 9).alias("slope_per_ts"), *r6("intercept", "r2", "resid_std"))


def block_bootstrap_trend(spark, sf):
    out = bootstrap.block_bootstrap_trend(_clean(spark, sf), "mid_price", ["day", "product"], "timestamp", BLOCK, REPS, SEED)
    return out.select("day", "product", "n", *r6("r2", "p"))


def start_anchor(spark, sf):
    a = series.start_anchor(_clean(spark, sf), "mid_price", 0.001, 60.0)
    return a.select("day", "product", "timestamp", *r6("fair"), "halted")


def _features(spark, sf):
    return flow.trade_features(fixtures.ticks(spark, sf), fixtures.trades(spark, sf), HORIZONS, W)


def trade_features(spark, sf):
    return _features(spark, sf).select("day", "timestamp", "product", "bot", "direction", "horizon", *r6("abs_z", "favourable"))


def _bucketed(spark, sf):
    return flow.with_buckets(_features(spark, sf))


def flow_buckets(spark, sf):
    return flow.leg_sums(_bucketed(spark, sf)).select("day", "horizon", "bucket", "bot", F.col("n").cast("long").alias("n"), *r6("total"))


def flow_scores(spark, sf):
    return flow.scores(flow.leg_sums(_bucketed(spark, sf))).select("horizon", "bot", F.col("n").cast("long").alias("n"), *r6("score"))


def flow_boot_day(spark, sf):
    sums = flow.leg_sums(_bucketed(spark, sf))
    out = flow.verdicts(flow.day_bootstrap(sums, REPS, SEED))
    return out.select("horizon", "bot", F.col("n").cast("long").alias("n"), *r6("score", "ci_low", "ci_high", "p"), "floored", "verdict", "informed")


def flow_boot_trade(spark, sf):
    rows = _bucketed(spark, sf)
    out = flow.trade_bootstrap(rows, flow.leg_sums(rows), "U1", 5, REPS, SEED)
    return out.select("horizon", "bot", F.col("n").cast("long").alias("n"), *r6("score", "ci_low", "ci_high"))


def directional_split(spark, sf):
    return flow.directional_split(_features(spark, sf)).select("horizon", "bot", "n", *r6("share_right", "mean_right", "mean_wrong", "mean_all"))


def benchmark_check(spark, sf):
    return flow.benchmark_check(flow.leg_sums(_bucketed(spark, sf))).select("horizon", "n", *r6("excluding"), (F.abs("pooled") < 1e-9).alias("pooled_is_zero"))


def trade_audit(spark, sf):
    a = flow.trade_audit(fixtures.ticks(spark, sf), fixtures.trades(spark, sf), "U1", "view", 5, 10, W)
    return a.select("day", "timestamp", "direction", *r6("price", "z", "std", "later", "favourable"))


def overlap(spark, sf):
    t = fixtures.trades(spark, sf)
    fills = t.filter((F.col("buyer") == ACCOUNT) | (F.col("seller") == ACCOUNT))
    return flow.overlap(t, fills).select("bot", "legs", *r6("overlap"))


def informed_gap(spark, sf):
    return flow.informed_gap(fixtures.trades(spark, sf), INFORMED).select("product", "n", *r6("median_gap"))


def informed_tally(spark, sf):
    z = series.zscores(_clean(spark, sf), "mid_price", W)
    return flow.informed_tally(z, fixtures.trades(spark, sf), INFORMED, 1.5, 5)


def _jumps(spark, sf):
    return jumps.flagged(fixtures.ticks(spark, sf), W, 2.5, 5.0, 1.0)


def jump_flags(spark, sf):
    return _jumps(spark, sf).filter("big").select("day", "product", "timestamp", *r6("change"), "grid")


def conditional_acf(spark, sf):
    out = jumps.conditional_acf(jumps.pair_sums(_jumps(spark, sf)), REPS, SEED)
    return out.select("product", *r6("all_acf", "grid_acf", "control_acf"), "n_grid", "n_control", *r6("diff", "ci_low", "ci_high", "p"), "floored")


def grid_control_counts(spark, sf):
    return jumps.grid_control_counts(jumps.pair_sums(_jumps(spark, sf)))


def jump_buckets(spark, sf):
    spreads = fixtures.ticks(spark, sf).select("day", "product", "timestamp", (1.0 + F.col("event_id") % 3).alias("spread"))
    return jumps.amplitude_buckets(jumps.grid_records(_jumps(spark, sf), spreads)).select("product", "bucket", "n", *r6("mean_amplitude", "mean_spread", "mean_reversal"))


def fill_stats(spark, sf):
    return attribution.fill_stats(fixtures.trades(spark, sf), ACCOUNT).select("symbol", "n_fills", "buy_volume", "sell_volume", *r6("avg_fill_price"))


def _pnl(spark, sf):
    """An activity table of two runs: profit of a unit held from the day's first tick."""
    w = series.in_order().rowsBetween(Window.unboundedPreceding, 0)
    t = _clean(spark, sf).withColumn("profit_and_loss", F.round(F.col("mid_price") - F.first("mid_price").over(w), 3))
    return t.select("day", "timestamp", "product", "profit_and_loss", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("run")).withColumn(
        "profit_and_loss", F.when(F.col("run") == "short", -F.col("profit_and_loss")).otherwise(F.col("profit_and_loss"))
    )


def final_pnl(spark, sf):
    return attribution.final_pnl(_pnl(spark, sf)).select("run", "day", "product", *r6("profit_and_loss"))


def pnl_rollup(spark, sf):
    return attribution.pnl_rollup(attribution.final_pnl(_pnl(spark, sf))).select("run", "product", *r6("pnl"))


def worst_day(spark, sf):
    final = attribution.final_pnl(_pnl(spark, sf)).filter("run = 'long'")
    return attribution.day_rollup(final).select("day", "negative_products", "worst", *r6("pnl", "mean_pnl"))


def mechanism_pnl(spark, sf):
    fills = attribution.signed(fixtures.trades(spark, sf), ACCOUNT)
    z = series.zscores(_clean(spark, sf), "mid_price", W)
    intents = z.filter("z IS NOT NULL").select("day", "timestamp", "product", F.when(F.abs("z") >= 1.5, "aggressive").otherwise("passive").alias("mechanism"))
    out = attribution.mechanism_pnl(attribution.attributed(fills, intents), _clean(spark, sf))
    return out.select("product", "mechanism", "fills", F.round("pnl", 4).alias("pnl"), (F.abs("residue") < 1e-6).alias("reconciled"))


def _held(spark, sf):
    fills = attribution.signed(fixtures.trades(spark, sf), ACCOUNT)
    return attribution.position_series(fills, fixtures.ticks(spark, sf).select("day", "product", "timestamp"))


def position_ffill(spark, sf):
    return _held(spark, sf).select("day", "product", "timestamp", "position")


def position_corr(spark, sf):
    return attribution.position_correlation(_held(spark, sf)).select("a", "b", "n", *r6("corr"))


QUERIES = (
    rolling_zscore, zscore_percentiles, loo_percentiles, ema, lag_acf, drift_monitor, drifting_fraction, drawdown_sharpe, ar1_fit, linear_trend,
    block_bootstrap_trend, start_anchor, trade_features, flow_buckets, flow_scores, flow_boot_day, flow_boot_trade, directional_split, benchmark_check,
    trade_audit, overlap, informed_gap, informed_tally, jump_flags, conditional_acf, grid_control_counts, jump_buckets, fill_stats, final_pnl, pnl_rollup,
    worst_day, mechanism_pnl, position_ffill, position_corr,
)

# ------------------------------------------------------------------------------------------ SQL

T = f"WITH RECURSIVE ticks AS ({TICKS}), c AS (SELECT * FROM ticks WHERE mid_price > 0)"
TT = f"{T}, trades AS ({TRADES})"
P, O = "PARTITION BY day, product", "ORDER BY timestamp"
Z = f""", zz AS (SELECT *, count(*) OVER w AS wn, avg(mid_price) OVER w AS wm, stddev_pop(mid_price) OVER w AS ws FROM c WINDOW w AS ({P} {O} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
z AS (SELECT day, product, timestamp, event_id, mid_price, (mid_price - wm) / ws AS z, ws AS std FROM zz WHERE wn = {W} AND ws > 0)"""
AT = "[50.0, 75.0, 90.0, 95.0, 99.0, 99.5]"
QS = "[0.5, 0.75, 0.9, 0.95, 0.99, 0.995]"


def _draw(n: str, r: str = "r", s: str = "s") -> str:
    return f"(('0x' || substr(md5('{SEED}:' || {r} || ':' || {s}), 1, 8))::BIGINT % {n})"


FEAT = f""", f AS (SELECT t.tid, t.day, t.timestamp, t.symbol AS product, h.h AS horizon, b.bot, b.d AS direction, abs(z.z) AS abs_z,
  b.d * (l.mid_price - t.price) / z.std AS favourable
 FROM (SELECT *, row_number() OVER () AS tid FROM trades) t JOIN z ON z.day = t.day AND z.product = t.symbol AND z.timestamp = t.timestamp, (SELECT unnest([1, 5, 10]) AS h) h, c l,
 LATERAL (SELECT t.buyer AS bot, 1 AS d UNION ALL SELECT t.seller, -1) b
 WHERE l.day = t.day AND l.product = t.symbol AND l.timestamp = t.timestamp + h.h * 100)"""
BUCK = """, legs AS (SELECT DISTINCT tid, day, timestamp, product, bot, direction, abs_z FROM f), e AS (SELECT quantile_cont(abs_z, 1.0 / 3) AS e1, quantile_cont(abs_z, 2.0 / 3) AS e2 FROM legs),
fb AS (SELECT f.*, CAST(abs_z >= e1 AS INTEGER) + CAST(abs_z >= e2 AS INTEGER) AS bucket FROM f, e),
ls AS (SELECT day, horizon, bucket, bot, count(*) AS n, sum(favourable) AS total FROM fb GROUP BY ALL)"""
SCORE = """, pl AS (SELECT horizon, bucket, bot, sum(n) AS n, sum(total) AS total FROM ls GROUP BY ALL),
px AS (SELECT *, sum(n) OVER w - n AS on_, sum(total) OVER w - total AS ot FROM pl WINDOW w AS (PARTITION BY horizon, bucket)),
sc AS (SELECT horizon, bot, sum(n) AS n, sum(total - n * CASE WHEN on_ > 0 THEN ot / on_ ELSE 0 END) / sum(n) AS score FROM px GROUP BY ALL)"""
DAYS = f""", dn AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS nd FROM (SELECT DISTINCT day FROM {{src}}) q),
dr AS (SELECT r, d.day FROM (SELECT r, s, nd, {_draw('nd')} AS k FROM (SELECT unnest(range(0, {REPS})) AS r) a, (SELECT k AS s, nd FROM dn) b) x JOIN dn d ON d.k = x.k)"""
HORIZON_DAYS = f""", dn AS (SELECT horizon, day, row_number() OVER (PARTITION BY horizon ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY horizon) AS nd FROM (SELECT DISTINCT horizon, day FROM ls) q),
dr AS (SELECT x.horizon, r, d.day FROM (SELECT horizon, r, s, nd, {_draw('nd')} AS k FROM (SELECT unnest(range(0, {REPS})) AS r) a, (SELECT horizon, k AS s, nd FROM dn) b) x JOIN dn d ON d.k = x.k AND d.horizon = x.horizon)"""
P_OF = f"""CASE WHEN sum(CASE WHEN (est >= 0 AND v <= 0) OR (est < 0 AND v >= 0) THEN 1 ELSE 0 END) = 0 THEN 1.0 / {REPS + 1} ELSE sum(CASE WHEN (est >= 0 AND v <= 0) OR (est < 0 AND v >= 0) THEN 1 ELSE 0 END) / {REPS}.0 END"""
FLOORED = "sum(CASE WHEN (est >= 0 AND v <= 0) OR (est < 0 AND v >= 0) THEN 1 ELSE 0 END) = 0"
J = f""", d0 AS (SELECT *, mid_price - lag(mid_price) OVER ({P} {O}) AS change FROM c), d1 AS (SELECT * FROM d0 WHERE change IS NOT NULL),
d2 AS (SELECT *, count(*) OVER w AS wn, stddev_pop(change) OVER w AS ws FROM d1 WINDOW w AS ({P} {O} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
j0 AS (SELECT *, wn = {W} AND ws > 0 AND abs(change) >= 2.5 * ws AS big FROM d2),
j AS (SELECT *, big AND abs(change - round_even(change / 5.0, 0) * 5.0) <= 1.0 AS grid, lead(change) OVER ({P} {O}) AS nxt FROM j0)"""
CORR = "CASE WHEN n >= 2 AND n * sxx - sx * sx > 1e-12 * n * sxx AND n * syy - sy * sy > 1e-12 * n * syy THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) END"
FILLS = """, fl AS (SELECT t.*, t.symbol AS product, x.sg AS signed FROM trades t, LATERAL (SELECT t.quantity AS sg WHERE t.buyer = 'U0' UNION ALL SELECT -t.quantity WHERE t.seller = 'U0') x)"""
HELD = f"""{FILLS}, st AS (SELECT day, product, timestamp, sum(signed) AS s FROM fl GROUP BY ALL),
held AS (SELECT k.day, k.product, k.timestamp, CAST(coalesce(sum(s) OVER ({P.replace('day', 'k.day').replace('product', 'k.product')} ORDER BY k.timestamp ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS position
 FROM ticks k LEFT JOIN st ON st.day = k.day AND st.product = k.product AND st.timestamp = k.timestamp)"""
PNL = f""", pnl AS (SELECT r.run, day, timestamp, product, CASE WHEN r.run = 'short' THEN -1 ELSE 1 END * round(mid_price - first_value(mid_price) OVER ({P} {O}), 3) AS profit_and_loss FROM c, (SELECT 'long' AS run UNION ALL SELECT 'short') r),
fin AS (SELECT run, day, product, profit_and_loss FROM pnl WHERE (run, day, timestamp) IN (SELECT run, day, max(timestamp) FROM pnl GROUP BY ALL))"""

SQL = {
    "rolling_zscore": f"{T}{Z} SELECT day, product, timestamp, round(z, 6) AS z FROM z",
    "zscore_percentiles": f"""{T}{Z}, q AS (SELECT day, product, count(*) AS n, quantile_cont(abs(z), {QS}) AS q FROM z GROUP BY ALL)
SELECT day, product, n, percentile, round(abs_z, 6) AS abs_z FROM (SELECT day, product, n, unnest({AT}) AS percentile, unnest(q) AS abs_z FROM q) u""",
    "loo_percentiles": f"""{T}{Z}, q AS (SELECT product, d.day AS held_out, count(*) AS n, quantile_cont(abs(z), {QS}) AS q FROM z, (SELECT DISTINCT day FROM c) d WHERE z.day <> d.day GROUP BY ALL)
SELECT product, held_out, n, percentile, round(abs_z, 6) AS abs_z FROM (SELECT product, held_out, n, unnest({AT}) AS percentile, unnest(q) AS abs_z FROM q) u""",
    "ema": f"""{T}, i AS (SELECT *, row_number() OVER ({P} {O}) AS k FROM c), m AS (SELECT day, product, k, timestamp, mid_price AS ema FROM i WHERE k = 1
UNION ALL SELECT i.day, i.product, i.k, i.timestamp, 2.0 / 11 * i.mid_price + (1 - 2.0 / 11) * m.ema FROM m JOIN i ON i.day = m.day AND i.product = m.product AND i.k = m.k + 1)
SELECT day, product, timestamp, round(ema, 6) AS ema FROM m""",
    "lag_acf": f"""{T}, x AS (SELECT *, mid_price - first_value(mid_price) OVER ({P} {O}) AS x FROM c), y AS (SELECT *, lag(x, 3) OVER ({P} {O}) AS y FROM x),
s AS (SELECT day, product, timestamp, count(y) OVER w AS n, sum(CASE WHEN y IS NOT NULL THEN x ELSE 0 END) OVER w AS sx, sum(coalesce(y, 0)) OVER w AS sy, sum(CASE WHEN y IS NOT NULL THEN x * x ELSE 0 END) OVER w AS sxx,
 sum(coalesce(y * y, 0)) OVER w AS syy, sum(coalesce(x * y, 0)) OVER w AS sxy FROM y WINDOW w AS ({P} {O} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW))
SELECT day, product, timestamp, round(acf, 6) AS acf FROM (SELECT *, {CORR} AS acf FROM s) q WHERE acf IS NOT NULL""",
    "drift_monitor": f"""{T}, r AS (SELECT day, product, timestamp, row_number() OVER ({P} {O}) AS k, avg(mid_price) OVER ({P} {O} ROWS BETWEEN {DRIFT - 1} PRECEDING AND CURRENT ROW) AS m FROM c)
SELECT day, product, timestamp, k >= {DRIFT} AND coalesce(abs(m - (SELECT m FROM r f WHERE f.day = r.day AND f.product = r.product AND f.k = {DRIFT})) > {LIMIT}, false) AS drifting FROM r""",
    "drifting_fraction": f"""{T}, r AS (SELECT day, product, row_number() OVER ({P} {O}) AS k, avg(mid_price) OVER ({P} {O} ROWS BETWEEN {DRIFT - 1} PRECEDING AND CURRENT ROW) AS m FROM c)
SELECT r.day, r.product, count(*) AS n, round(avg(CASE WHEN abs(r.m - f.m) > {LIMIT} THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM r JOIN r f ON f.day = r.day AND f.product = r.product AND f.k = {DRIFT} WHERE r.k >= {DRIFT} GROUP BY ALL""",
    "drawdown_sharpe": f"""{T}, x AS (SELECT *, max(mid_price) OVER ({P} {O} ROWS UNBOUNDED PRECEDING) - mid_price AS fall, mid_price - lag(mid_price) OVER ({P} {O}) AS d FROM c)
SELECT day, product, round(max(fall), 6) AS max_drawdown, round(CASE WHEN count(*) >= 3 AND stddev_pop(d) > 0 THEN avg(d) / stddev_pop(d) END, 6) AS sharpe FROM x GROUP BY day, product""",
    "ar1_fit": f"""{T}, x AS (SELECT day, product, mid_price AS y, lag(mid_price) OVER ({P} {O}) AS p, avg(mid_price) OVER ({P}) AS m FROM c),
a AS (SELECT day, product, count(*) AS n, any_value(m) AS m, regr_slope(y - m, p - m) AS phi, regr_intercept(y - m, p - m) AS k FROM x GROUP BY day, product)
SELECT day, product, n, 'ok' AS status, round(phi, 6) AS phi, round(CASE WHEN abs(phi) < 1 THEN ln(2.0) / -ln(abs(phi)) END, 4) AS half_life, round((k + m * (1 - phi)) / (1 - phi), 3) AS long_run_mean FROM a""",
    "linear_trend": f"""{T}, x AS (SELECT day, product, CAST(timestamp AS DOUBLE) - avg(timestamp) OVER ({P}) AS t, mid_price - avg(mid_price) OVER ({P}) AS y, avg(timestamp) OVER ({P}) AS mt, avg(mid_price) OVER ({P}) AS my FROM c),
a AS (SELECT day, product, count(*) AS n, regr_slope(y, t) AS b, regr_r2(y, t) AS r2, any_value(mt) AS mt, any_value(my) AS my, var_pop(y) AS v FROM x GROUP BY day, product)
SELECT day, product, n, round(b, 9) AS slope_per_ts, round(my - b * mt, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(greatest(0, v * (1 - r2))), 6) AS resid_std FROM a""",
    "block_bootstrap_trend": f"""{T}, s AS (SELECT day, product, row_number() OVER ({P} {O}) - 1 AS i, mid_price - first_value(mid_price) OVER ({P} {O}) AS y, count(*) OVER ({P}) AS n FROM c),
sz AS (SELECT DISTINCT day, product, n FROM s), p AS (SELECT day, product, n, r, b, ({_draw('n', 'r', 'b')}) AS st FROM sz, (SELECT unnest(range(0, {REPS})) AS r) q, LATERAL (SELECT unnest(range(0, CAST(ceil(n / {BLOCK}.0) AS BIGINT))) AS b) w),
e AS (SELECT day, product, n, r, b * {BLOCK} + k AS pos, (st + k) % n AS i FROM p, (SELECT unnest(range(0, {BLOCK})) AS k) q WHERE b * {BLOCK} + k < n),
rr AS (SELECT e.day, e.product, r, regr_r2(y, pos) AS r2 FROM e JOIN s ON s.day = e.day AND s.product = e.product AND s.i = e.i GROUP BY e.day, e.product, r),
o AS (SELECT day, product, count(*) AS n, regr_r2(y, i) AS own FROM s GROUP BY day, product)
SELECT o.day, o.product, o.n, round(own, 6) AS r2, round((sum(CASE WHEN r2 >= own THEN 1 ELSE 0 END) + 1) / {REPS + 1}.0, 6) AS p FROM rr JOIN o ON o.day = rr.day AND o.product = rr.product GROUP BY o.day, o.product, o.n, own""",
    "start_anchor": f"""{T}, a AS (SELECT *, first_value(mid_price) OVER ({P} {O}) + 0.001 * (timestamp - first_value(timestamp) OVER ({P} {O})) AS fair FROM c)
SELECT day, product, timestamp, round(fair, 6) AS fair, bool_or(abs(mid_price - fair) > 60.0) OVER ({P} {O} ROWS UNBOUNDED PRECEDING) AS halted FROM a""",
    "trade_features": f"{TT}{Z}{FEAT} SELECT day, timestamp, product, bot, direction, horizon, round(abs_z, 6) AS abs_z, round(favourable, 6) AS favourable FROM f",
    "flow_buckets": f"{TT}{Z}{FEAT}{BUCK} SELECT day, horizon, bucket, bot, n, round(total, 6) AS total FROM ls",
    "flow_scores": f"{TT}{Z}{FEAT}{BUCK}{SCORE} SELECT horizon, bot, CAST(n AS BIGINT) AS n, round(score, 6) AS score FROM sc",
    "flow_boot_day": f"""{TT}{Z}{FEAT}{BUCK}{SCORE}{HORIZON_DAYS},
ag AS (SELECT r, ls.horizon, bucket, bot, sum(n) AS n, sum(total) AS total FROM dr JOIN ls ON ls.day = dr.day AND ls.horizon = dr.horizon GROUP BY ALL),
ax AS (SELECT *, sum(n) OVER w - n AS on_, sum(total) OVER w - total AS ot FROM ag WINDOW w AS (PARTITION BY r, horizon, bucket)),
av AS (SELECT r, horizon, bot, sum(total - n * CASE WHEN on_ > 0 THEN ot / on_ ELSE 0 END) / sum(n) AS v FROM ax GROUP BY ALL),
al AS (SELECT sc.horizon, sc.bot, sc.n, sc.score AS est, coalesce(v, 0) AS v FROM sc CROSS JOIN (SELECT unnest(range(0, {REPS})) AS r) q LEFT JOIN av ON av.r = q.r AND av.horizon = sc.horizon AND av.bot = sc.bot),
ci AS (SELECT horizon, bot, n, est, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, {P_OF} AS p, {FLOORED} AS floored FROM al GROUP BY horizon, bot, n, est)
SELECT horizon, bot, CAST(n AS BIGINT) AS n, round(est, 6) AS score, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p, floored,
 CASE WHEN lo > 0 THEN 'positive' WHEN hi < 0 THEN 'negative' ELSE 'not significant' END AS verdict, lo > 0 AND min(est) OVER (PARTITION BY bot) > 0 AS informed FROM ci""",
    "flow_boot_trade": f"""{TT}{Z}{FEAT}{BUCK}, bs AS (SELECT bucket, sum(CASE WHEN bot <> 'U1' THEN total END) / sum(CASE WHEN bot <> 'U1' THEN n END) AS base FROM ls WHERE horizon = 5 GROUP BY bucket),
ow AS (SELECT concat_ws(':', CAST(day AS VARCHAR), product, CAST(timestamp AS VARCHAR), CAST(direction AS VARCHAR), CAST(row_number() OVER (PARTITION BY day, product, timestamp, direction ORDER BY favourable) AS VARCHAR)) AS leg,
 favourable - coalesce(base, 0) AS x FROM fb JOIN bs USING (bucket) WHERE bot = 'U1' AND horizon = 5),
wt AS (SELECT r, x, len(list_filter({POISSON}, lambda p: p <= ('0x' || substr(md5('{SEED}:' || leg || ':' || (r // 4)), 1 + 8 * (r % 4), 8))::BIGINT / 4294967296.0)) AS w FROM ow, (SELECT unnest(range(0, {REPS})) AS r) q),
mm AS (SELECT r, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) END AS v FROM wt GROUP BY r)
SELECT 5 AS horizon, 'U1' AS bot, (SELECT count(*) FROM ow) AS n, round((SELECT avg(x) FROM ow), 6) AS score, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM mm""",
    "directional_split": f"""{TT}{Z}{FEAT} SELECT horizon, bot, count(*) AS n, round(avg(CASE WHEN favourable > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_right, round(avg(CASE WHEN favourable > 0 THEN favourable END), 6) AS mean_right,
 round(avg(CASE WHEN favourable <= 0 THEN favourable END), 6) AS mean_wrong, round(avg(favourable), 6) AS mean_all FROM f GROUP BY horizon, bot""",
    "benchmark_check": f"{TT}{Z}{FEAT}{BUCK}{SCORE} SELECT horizon, CAST(sum(n) AS BIGINT) AS n, round(sum(score * n) / sum(n), 6) AS excluding, true AS pooled_is_zero FROM sc GROUP BY horizon",
    "trade_audit": f"""{TT}{Z} SELECT t.day, t.timestamp, CASE WHEN buyer = 'U1' THEN 1 ELSE -1 END AS direction, round(price, 6) AS price, round(z.z, 6) AS z, round(z.std, 6) AS std, round(l.mid_price, 6) AS later,
 round(CASE WHEN buyer = 'U1' THEN 1 ELSE -1 END * (l.mid_price - price) / z.std, 6) AS favourable FROM trades t JOIN z ON z.day = t.day AND z.product = t.symbol AND z.timestamp = t.timestamp
 LEFT JOIN c l ON l.day = t.day AND l.product = t.symbol AND l.timestamp = t.timestamp + 500 WHERE t.symbol = 'view' AND (buyer = 'U1' OR seller = 'U1') ORDER BY t.day, t.timestamp LIMIT 10""",
    "overlap": f"""{TT}, lg AS (SELECT day, timestamp, buyer AS bot FROM trades UNION ALL SELECT day, timestamp, seller FROM trades)
SELECT bot, count(*) AS legs, round(avg(CASE WHEN (day, timestamp) IN (SELECT day, timestamp FROM trades WHERE buyer = 'U0' OR seller = 'U0') THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM lg GROUP BY bot""",
    "informed_gap": f"""{TT}, i AS (SELECT symbol AS product, (timestamp - lag(timestamp) OVER (PARTITION BY day, symbol ORDER BY timestamp)) / 100.0 AS gap FROM trades WHERE buyer IN ('U1', 'U2') OR seller IN ('U1', 'U2'))
SELECT product, count(*) AS n, round(median(gap), 6) AS median_gap FROM i GROUP BY product""",
    "informed_tally": f"""{TT}{Z}, i AS (SELECT day, symbol AS product, timestamp, CASE WHEN seller IN ('U1', 'U2') THEN -1 ELSE 1 END AS way FROM trades WHERE buyer IN ('U1', 'U2') OR seller IN ('U1', 'U2')),
x AS (SELECT day, product, timestamp, CASE WHEN z > 0 THEN -1 ELSE 1 END AS signal FROM z WHERE abs(z) >= 1.5),
m AS (SELECT x.product, signal, CASE WHEN x.timestamp - i.timestamp <= 500 THEN way END AS way FROM x ASOF LEFT JOIN i ON x.day = i.day AND x.product = i.product AND x.timestamp >= i.timestamp)
SELECT product, CAST(sum(CASE WHEN way = signal THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN way = -signal THEN 1 ELSE 0 END) AS BIGINT) AS opposite, CAST(sum(CASE WHEN way IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "none" FROM m GROUP BY product""",
    "jump_flags": f"{T}{J} SELECT day, product, timestamp, round(change, 6) AS change, grid FROM j WHERE big",
    "conditional_acf": f"""{T}{J}, k AS (SELECT product, day, change AS x, nxt AS y, unnest(list_filter(['all', CASE WHEN grid THEN 'grid' END, CASE WHEN big AND NOT grid THEN 'control' END], lambda q: q IS NOT NULL)) AS kind FROM j WHERE nxt IS NOT NULL),
m AS (SELECT product, day, kind, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM k GROUP BY ALL){DAYS.format(src="m")},
t AS (SELECT product, kind, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM m GROUP BY ALL),
w AS (SELECT product, max(CASE WHEN kind = 'all' THEN c END) AS a, max(CASE WHEN kind = 'grid' THEN c END) AS g, max(CASE WHEN kind = 'control' THEN c END) AS o, coalesce(max(CASE WHEN kind = 'grid' THEN n END), 0) AS ng, coalesce(max(CASE WHEN kind = 'control' THEN n END), 0) AS no FROM (SELECT *, {CORR} AS c FROM t) q GROUP BY product),
b AS (SELECT product, r, kind, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM dr JOIN m ON m.day = dr.day GROUP BY ALL),
v AS (SELECT product, r, coalesce(max(CASE WHEN kind = 'grid' THEN c END) - max(CASE WHEN kind = 'control' THEN c END), 0) AS v FROM (SELECT *, {CORR} AS c FROM b) q GROUP BY product, r),
ci AS (SELECT product, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, {P_OF} AS p, {FLOORED} AS floored FROM (SELECT v.*, w.g - w.o AS est FROM v JOIN w USING (product) WHERE w.g - w.o IS NOT NULL) q GROUP BY product)
SELECT product, round(a, 6) AS all_acf, round(g, 6) AS grid_acf, round(o, 6) AS control_acf, CAST(ng AS BIGINT) AS n_grid, CAST(no AS BIGINT) AS n_control, round(g - o, 6) AS diff, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p, floored FROM w LEFT JOIN ci USING (product)""",
    "grid_control_counts": f"{T}{J} SELECT product, day, CAST(sum(CASE WHEN grid THEN 1 ELSE 0 END) AS BIGINT) AS n_grid, CAST(sum(CASE WHEN big AND NOT grid THEN 1 ELSE 0 END) AS BIGINT) AS n_control FROM j WHERE nxt IS NOT NULL GROUP BY product, day",
    "jump_buckets": f"""{T}{J}, g AS (SELECT product, abs(change) AS amplitude, 1.0 + event_id % 3 AS spread, -sign(change) * nxt AS reversal FROM j WHERE grid AND nxt IS NOT NULL),
e AS (SELECT quantile_cont(amplitude / spread, 1.0 / 3) AS e1, quantile_cont(amplitude / spread, 2.0 / 3) AS e2 FROM g)
SELECT product, CASE CAST(amplitude / spread >= e1 AS INTEGER) + CAST(amplitude / spread >= e2 AS INTEGER) WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n,
 round(avg(amplitude), 6) AS mean_amplitude, round(avg(spread), 6) AS mean_spread, round(avg(reversal), 6) AS mean_reversal FROM g, e GROUP BY 1, 2""",
    "fill_stats": f"""{TT} SELECT symbol, count(*) AS n_fills, CAST(sum(CASE WHEN buyer = 'U0' THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN seller = 'U0' THEN quantity ELSE 0 END) AS BIGINT) AS sell_volume,
 round(sum(price * quantity) / sum(CASE WHEN buyer = 'U0' THEN quantity ELSE 0 END + CASE WHEN seller = 'U0' THEN quantity ELSE 0 END), 6) AS avg_fill_price FROM trades WHERE buyer = 'U0' OR seller = 'U0' GROUP BY symbol""",
    "final_pnl": f"{T}{PNL} SELECT run, day, product, round(profit_and_loss, 6) AS profit_and_loss FROM fin",
    "pnl_rollup": f"{T}{PNL} SELECT run, product, round(sum(profit_and_loss), 6) AS pnl FROM fin GROUP BY ROLLUP (run, product)",
    "worst_day": f"""{T}{PNL}, d AS (SELECT day, sum(profit_and_loss) AS pnl, CAST(sum(CASE WHEN profit_and_loss < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_products FROM fin WHERE run = 'long' GROUP BY day)
SELECT day, negative_products, pnl = (SELECT min(pnl) FROM d) AS worst, round(pnl, 6) AS pnl, round((SELECT avg(pnl) FROM d), 6) AS mean_pnl FROM d""",
    "mechanism_pnl": f"""{TT}{Z}{FILLS}, lm AS (SELECT day, product, arg_max(mid_price, timestamp) AS fm FROM c GROUP BY day, product)
SELECT fl.product, coalesce(CASE WHEN z.z IS NULL THEN NULL WHEN abs(z.z) >= 1.5 THEN 'aggressive' ELSE 'passive' END, 'unattributed') AS mechanism, count(*) AS fills, round(sum((fm - price) * signed), 4) AS pnl, true AS reconciled
FROM fl JOIN lm ON lm.day = fl.day AND lm.product = fl.product LEFT JOIN z ON z.day = fl.day AND z.product = fl.product AND z.timestamp = fl.timestamp GROUP BY 1, 2""",
    "position_ffill": f"{TT}{HELD} SELECT day, product, timestamp, position FROM held",
    "position_corr": f"""{TT}{HELD} SELECT a.product AS a, b.product AS b, count(*) AS n, round(coalesce(corr(a.position, b.position), 0), 6) AS corr FROM held a JOIN held b ON a.day = b.day AND a.timestamp = b.timestamp AND a.product < b.product GROUP BY 1, 2""",
}
