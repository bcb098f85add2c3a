"""Queries that write the tapes as files of every format, read them back, and stream them; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import cross, flow, options, regime, series
from tapeline.operators.scratch import folder
from tapeline.plans import fixtures, market_queries, ticks_queries
from tapeline.plans.market_queries import IV, PN
from tapeline.plans.ticks_queries import BUCK, FEAT, SCORE, TT, DRIFT, INFORMED, LIMIT, O, P, T, W, Z, r6
from tapeline.schema import PRICES, TRADES
from tapeline.sources import logs, tape
from tapeline.streaming import stateful

LONG, SLOPE, GUARD, LOOKBACK, STRIDE, WIDE, LATE = 200, 0.001, 60.0, 500, 20, 1000, 50
LAGS_WIDE = list(range(-20, 21))
#: Events whose run logs one task writes.
EVENTS_A_TASK = 200_000


def _filled(df: DataFrame, schema) -> DataFrame:
    """df with all columns of a schema; those that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _prices(spark, sf) -> DataFrame:
    """The ticks as a price tape with one level on either side."""
    t, e = fixtures.ticks(spark, sf), F.col("event_id")
    made = {"bid_price_1": F.col("mid_price") - 1, "bid_volume_1": 1 + e % 9, "ask_price_1": F.col("mid_price") + 2, "ask_volume_1": F.when(e % 4 > 0, e % 7), "profit_and_loss": (e % 11 - 5) / 2}
    return _filled(t.withColumns(made), PRICES)


PRICE_OUT = ("day", "timestamp", "product", "bid_price_1", "bid_volume_1", "bid_price_2", "ask_price_1", "ask_volume_1", "mid_price", "profit_and_loss")


def price_tape_file(spark, sf):
    path = folder(spark, "tape")
    _prices(spark, sf).write.option("sep", ";").option("header", True).csv(path)
    return tape.read_prices(spark, path).select(*PRICE_OUT)


def trade_tape_file(spark, sf):
    path = folder(spark, "tape")
    _filled(fixtures.trades(spark, sf), TRADES).write.option("sep", ";").option("header", True).csv(path)
    return tape.read_trades(spark, path)


def parquet_tape(spark, sf):
    """Two rounds in one tape, a day of the first overwritten; some days of the first are read."""
    path, rows = folder(spark, "tape"), _prices(spark, sf)
    tape.write_tape(rows, path, 1)
    tape.write_tape(rows, path, 2)
    tape.write_tape(rows.filter("day = 0").withColumn("mid_price", F.col("mid_price") + 1), path, 1)
    return tape.read_tape(spark, path, 1, [0, 2]).select("day", "timestamp", "product", "mid_price")


def _logs(spark, sf) -> DataFrame:
    """Run logs of up to 1000 ticks of a day and product each, written and read back. Tasks are as many as the events ask for."""
    run = lambda product: F.concat_ws("-", "day", product, F.floor(F.col("timestamp") / 100_000))
    parts = fixtures._table(spark, sf, "events").count() // EVENTS_A_TASK + 1
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c.alias("line")))), lambda x: x["line"]), "\n")
    acts = _prices(spark, sf).withColumn("run", run("product")).repartition(parts, "run").groupBy("run").agg(listed(F.concat_ws(";", *[text(f.name) for f in PRICES]), "timestamp").alias("acts"))
    names = [f.name for f in TRADES]
    field = lambda n: F.concat(F.lit(f'  "{n}": '), text(n) if n in ("timestamp", "price", "quantity") else F.concat(F.lit('"'), text(n), F.lit('"')), F.lit(",\n"))
    t = fixtures.trades(spark, sf).withColumn("currency", F.lit("X"))
    deals = t.withColumn("run", run("symbol")).repartition(parts, "run").groupBy("run").agg(listed(F.concat(F.lit("{\n"), *[field(n) for n in names], F.lit("},")), "timestamp").alias("deals"))
    whole = F.concat(F.lit(f"Sandbox logs:\n\nActivities log:\n{';'.join(f.name for f in PRICES)}\n"), "acts", F.lit("\n\nTrade History:\n[\n"), F.coalesce("deals", F.lit("")), F.lit("\n]\n"))
    path = folder(spark, "tape")
    acts.join(deals, "run", "left").select("run", whole.alias("text")).write.partitionBy("run").text(path)
    return logs.read_logs(spark, path)


def activity_log(spark, sf):
    return logs.activities(_logs(spark, sf)).select("day", "timestamp", "product", "mid_price", "profit_and_loss")


def trade_history(spark, sf):
    return logs.trade_history(_logs(spark, sf)).select("timestamp", "buyer", "seller", "symbol", "price", "quantity")


def result_table(spark, sf):
    """A result of another query, written as a table and read back."""
    path = folder(spark, "tape")
    cross.family_correlations(fixtures.panel(spark, sf)).write.partitionBy("day").parquet(path)
    return spark.read.parquet(path).select(F.col("day").cast("int").alias("day"), "family", "a", "b", *r6("corr"))


def mid_series(spark, sf):
    return series.mid_series(_prices(spark, sf), "view")


#: A tick far ahead, whose watermark closes all series, and the day that it is of.
FAR = 1000


def _arrives(rows: DataFrame, path: str, last: bool = True) -> None:
    """Rows (day, timestamp, product, mid_price) as a file of a tape that streams read; the last one has a tick far ahead."""
    end = rows.sparkSession.createDataFrame([(FAR, "end", 0, 1.0)] if last else [], "day int, product string, timestamp long, mid_price double")
    _filled(rows.unionByName(end), PRICES).write.mode("append").parquet(path)


def _drained(out: DataFrame, path: str):
    """Runs a stream until its input is used up; its rows go to `path`/out, its state to `path`/state."""
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append")
    query = query.trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return query


def _ticking(spark: SparkSession, path: str) -> DataFrame:
    return stateful.with_event_time(tape.stream_prices(spark, path, 1000))


def _streamed(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """An indicator over rows (day, timestamp, product, mid_price) that arrive as a stream of files. What came out
    is read back from the stream's sink."""
    path = folder(spark, "tape")
    _arrives(rows, f"{path}/in")
    _drained(stateful.indicators(_ticking(stateful.session(spark), f"{path}/in"), "mid_price", make), path)
    return spark.read.parquet(f"{path}/out").filter(F.col("day") < FAR)


def _ticks(spark, sf) -> DataFrame:
    return series.clean_mids(fixtures.ticks(spark, sf)).select("day", "product", "timestamp", "mid_price")


def stream_rolling(spark, sf):
    out = _streamed(spark, _ticks(spark, sf), lambda: stateful.Rolling(W))
    return out.filter("z IS NOT NULL AND NOT isnan(z)").select("day", "product", "timestamp", *r6("z"))


def stream_ema(spark, sf):
    return _streamed(spark, _ticks(spark, sf), lambda: stateful.Ema(10)).select("day", "product", "timestamp", *r6("ema"))


def stream_acf(spark, sf):
    out = _streamed(spark, _ticks(spark, sf), lambda: stateful.LagAcf(W, 3))
    return out.filter("acf IS NOT NULL AND NOT isnan(acf)").select("day", "product", "timestamp", *r6("acf"))


def stream_drift(spark, sf):
    out = _streamed(spark, _ticks(spark, sf), lambda: stateful.Drift(DRIFT, LIMIT))
    return out.select("day", "product", "timestamp", (F.col("drifting") > 0).alias("drifting"))


def stream_anchor(spark, sf):
    out = _streamed(spark, _ticks(spark, sf), lambda: stateful.Guard(GUARD, SLOPE))
    return out.select("day", "product", "timestamp", *r6("fair"), (F.col("halted") > 0).alias("halted"))


def stream_last_event(spark, sf):
    """For each tick, the latest informed trade's direction and age within the lookback: a stream of ticks and one of
    trades, each from its own files."""
    path, own = folder(spark, "tape"), stateful.session(spark)
    events = flow.informed_events(fixtures.trades(spark, sf), INFORMED).select("day", "product", "timestamp", F.col("way").cast("double").alias("mid_price"))
    _arrives(_ticks(spark, sf), f"{path}/ticks")
    _arrives(events, f"{path}/trades")
    trades = _ticking(own, f"{path}/trades").withColumnRenamed("mid_price", "way")
    _drained(stateful.last_events(_ticking(own, f"{path}/ticks"), trades, "way", LOOKBACK), path)
    known = lambda c: F.when(~F.isnan(c), F.col(c).cast("long"))
    return spark.read.parquet(f"{path}/out").filter(F.col("day") < FAR).select("day", "product", "timestamp", known("way").alias("way"), known("age").alias("age"))


def stream_rolling_wide(spark, sf):
    """A window of 1000 ticks: a tick costs what it does for one of 20."""
    out = _streamed(spark, _ticks(spark, sf), lambda: stateful.Rolling(WIDE))
    return out.select("day", "product", "timestamp", F.col("n").cast("long").alias("n"), F.round(F.col("mean") * F.col("n"), 3).alias("total"))


def stream_late_rows(spark, sf):
    """Every 50th tick comes after the watermark has passed all days: it comes out flagged, once, and changes nothing."""
    path, own = folder(spark, "tape"), stateful.session(spark)
    rows = series.clean_mids(fixtures.ticks(spark, sf)).withColumn("late", F.col("event_id") % LATE == 0)
    ticks = lambda late: rows.filter(F.col("late") == late).select("day", "product", "timestamp", "mid_price")
    for late in (False, True):
        _arrives(ticks(late), f"{path}/in", not late)
        _drained(stateful.indicators(_ticking(own, f"{path}/in"), "mid_price", lambda: stateful.Ema(10)), path)
    out = spark.read.parquet(f"{path}/out").filter(F.col("day") < FAR)
    return out.select("day", "product", "timestamp", "late", F.when(~F.isnan("ema"), F.round("ema", 6)).alias("ema"))


def stream_day_end(spark, sf):
    """Per day and product: ticks, the ema's first value (each day starts from nothing), and how many entries of the key's state
    are left once the day is over."""
    path, own = folder(spark, "tape"), stateful.session(spark)
    _arrives(_ticks(spark, sf), f"{path}/in")
    make = lambda: stateful.Drift(DRIFT, LIMIT)
    _drained(stateful.indicators(_ticking(own, f"{path}/in"), "mid_price", make), path)
    state = own.read.format("statestore").option("path", f"{path}/state")
    left = [state.option("stateVarName", name).load().select("key.day", "key.product") for name in ("scalars", "timer")]
    left.append(state.option("stateVarName", "ring").load().select("key.day", "key.product"))
    kept = left[0].unionByName(left[1]).unionByName(left[2]).filter(F.col("day") < FAR).groupBy("day", "product").agg(F.count("*").alias("entries"))
    out = spark.read.parquet(f"{path}/out").filter(F.col("day") < FAR)
    found = out.groupBy("day", "product").agg(F.count("*").alias("ticks"), F.min_by("value", "timestamp").alias("first"), F.sum("drifting").cast("long").alias("drifting"))
    return found.join(kept, ["day", "product"], "left").select("day", "product", "ticks", *r6("first"), "drifting", F.coalesce("entries", F.lit(0)).alias("entries_left"))


def option_quotes(spark, sf):
    """Options of a tape, known by their names, with the spot of the same tick."""
    t, q = _ticks(spark, sf), fixtures.quotes(spark, sf)
    options_ = q.select("day", "timestamp", F.concat(F.lit("CALL_"), "strike").alias("product"), F.col("price").alias("mid_price"))
    others = t.filter("product <> 'view'").select("day", "timestamp", F.concat("product", F.lit("_x")).alias("product"), "mid_price")
    found = options.quotes(options_.unionByName(others), t.filter("product = 'view'"), "CALL")
    return found.select("day", "timestamp", "strike", *r6("price", "spot"))


def ranked_identities(spark, sf):
    return cross.ranked_fits(cross.within_families(fixtures.panel(spark, sf))).select("family", "rank", "product", *r6("r2"))


def _tick_panel(spark, sf) -> DataFrame:
    return _ticks(spark, sf).withColumn("family", F.lit(1))


def ranked_leads(spark, sf):
    """Ordered pairs of products by their largest lagged correlation, over 41 lags of every tick."""
    found = cross.lead_lag(cross.lag_sums(_tick_panel(spark, sf), LAGS_WIDE))
    return cross.ranked_leads(found).select("family", "rank", "leader", "follower", "peak_lag", *r6("peak"))


def pair_diagnostics_wide(spark, sf):
    """Two products' spread with blocks of 200 ticks, 2000 replicates and a rolling deviation of 1000 ticks."""
    t = _ticks(spark, sf)
    costs = t.select("day", "product").distinct().withColumn("median_spread", F.lit(2.0))
    out = cross.pair_diagnostics(t, "view", "click", WIDE, 200, 2000, ticks_queries.SEED, costs)
    return out.select("day", *r6("phi", "trend_p", "rolling_std", "round_trip_cost", "amplitude_over_cost"), F.round("half_life", 4).alias("half_life"))


def rolling_zscore_long(spark, sf):
    """A window of the reference's length, in blocks of a series, by prefix sums."""
    z = series.in_blocks(_ticks(spark, sf), lambda rows, keys: series.zscore(rows, "mid_price", LONG, keys), LONG, 2 * LONG, 20_000)
    return z.filter("z IS NOT NULL").select("day", "product", "timestamp", *r6("z"))


def stride_sample(spark, sf):
    """Every 20th clean tick: the sampling that a scan may ask for."""
    return series.every(_ticks(spark, sf), STRIDE).select("day", "product", "timestamp", *r6("mid_price"))


def anchor_lag(spark, sf):
    return regime.anchor_lag(_ticks(spark, sf), "mid_price", W).select("day", "product", "n", *r6("mean_lag", "std_lag"))


def family_ar1(spark, sf):
    return regime.ar1(fixtures.panel(spark, sf), "mid_price", ("day", "family", "product")).select("day", "family", "product", "n", *r6("phi"))


def iv_trend_mean(spark, sf):
    found = options.trend_consistency(options.implied(fixtures.quotes(spark, sf)))
    return found.agg(F.count("*").alias("series"), F.round(F.avg("relative_slope") * 1e6, 4).alias("per_million"))


def ranked_bots(spark, sf):
    return flow.ranked(flow.scores(flow.leg_sums(ticks_queries._bucketed(spark, sf)))).select("horizon", "rank", "bot", *r6("score"))


def thin_scan(spark, sf):
    return options.thin(market_queries.expiry_scan(spark, sf), 5)


QUERIES = (
    price_tape_file, trade_tape_file, parquet_tape, activity_log, trade_history, result_table, mid_series, stream_rolling, stream_ema, stream_acf, stream_drift,
    stream_anchor, stream_last_event, stream_rolling_wide, stream_late_rows, stream_day_end, option_quotes, ranked_identities, ranked_leads, pair_diagnostics_wide, rolling_zscore_long, stride_sample, anchor_lag, family_ar1, iv_trend_mean, ranked_bots, thin_scan,
)

# ------------------------------------------------------------------------------------------ SQL

PT = f"""{T}, pt AS (SELECT day, timestamp, product, mid_price - 1 AS bid_price_1, CAST(1 + event_id % 9 AS DOUBLE) AS bid_volume_1, CAST(NULL AS DOUBLE) AS bid_price_2, mid_price + 2 AS ask_price_1,
 CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 7 AS DOUBLE) END AS ask_volume_1, mid_price, (event_id % 11 - 5) / 2.0 AS profit_and_loss FROM ticks)"""
_SAME = {"stream_ema": "ema", "stream_acf": "lag_acf", "stream_drift": "drift_monitor", "stream_rolling": "rolling_zscore", "stream_anchor": "start_anchor"}


def _wide_leads() -> str:
    """The lagged correlations of ticks in place of the panel's, at 41 lags."""
    text = f"{market_queries.LL}{market_queries.PEAK}".replace(str(market_queries.LAGS), str(LAGS_WIDE))
    return text.replace(PN, f"{T}, panel AS (SELECT day, timestamp, product, mid_price, 1 AS family FROM c)", 1).replace(", c AS (SELECT *, row_number()", ", cc AS (SELECT *, row_number()").replace("FROM c x,", "FROM cc x,").replace(", c y WHERE", ", cc y WHERE")


def _wide_pair() -> str:
    """pair_diagnostics of two products of the ticks, with wide windows."""
    text = market_queries.SQL["pair_diagnostics"].replace(PN, f"{T}, panel AS (SELECT * FROM c)", 1)
    for a, b in (
        (f"range(0, {ticks_queries.REPS})", "range(0, 2000)"), ("x.product = 5 AND y.product = 6", "x.product = 'view' AND y.product = 'click'"), ("n / 3.0", "n / 200.0"), ("b * 3", "b * 200"), ("range(0, 3)", "range(0, 200)"),
        (f"/ {ticks_queries.REPS + 1}.0", "/ 2001.0"), ("4 PRECEDING", f"{WIDE - 1} PRECEDING"), ("wn = 5", f"wn = {WIDE}"),
        ("r2 >= own", "r2 >= own - 1e-9"), ("5.0 AS round_trip_cost", "4.0 AS round_trip_cost"), ("round(rs, 2)", "round(rs, 6)"), ("round(rs / 5.0, 2)", "round(rs / 4.0, 6)"),
    ):
        assert a in text, a
        text = text.replace(a, b)
    return text


SQL = {name: ticks_queries.SQL[of] for name, of in _SAME.items()} | {
    "price_tape_file": f"{PT} SELECT {', '.join(PRICE_OUT)} FROM pt",
    "trade_tape_file": f"{TT} SELECT timestamp, buyer, seller, symbol, '' AS currency, price, quantity FROM trades",
    "parquet_tape": f"{PT} SELECT day, timestamp, product, mid_price + CASE WHEN day = 0 THEN 1 ELSE 0 END AS mid_price FROM pt WHERE day IN (0, 2)",
    "activity_log": f"{PT} SELECT day, timestamp, product, mid_price, profit_and_loss FROM pt",
    "trade_history": f"{TT} SELECT timestamp, buyer, seller, symbol, price, quantity FROM trades",
    "result_table": market_queries.SQL["family_corr"],
    "mid_series": f"{PT} SELECT day, timestamp, mid_price FROM pt WHERE product = 'view'",
    "stream_last_event": f"""{TT}, i AS (SELECT day, symbol AS product, timestamp, CASE WHEN seller IN ('U1', 'U2') THEN -1 ELSE 1 END AS way FROM trades WHERE buyer IN ('U1', 'U2') OR seller IN ('U1', 'U2')),
m AS (SELECT c.day, c.product, c.timestamp, way, c.timestamp - i.timestamp AS age FROM c ASOF LEFT JOIN i ON c.day = i.day AND c.product = i.product AND c.timestamp >= i.timestamp)
SELECT day, product, timestamp, CAST(CASE WHEN age <= {LOOKBACK} THEN way END AS BIGINT) AS way, CAST(CASE WHEN age <= {LOOKBACK} THEN age END AS BIGINT) AS age FROM m""",
    "rolling_zscore_long": f"{T}{Z.replace(f'{W - 1} PRECEDING', f'{LONG - 1} PRECEDING').replace(f'wn = {W}', f'wn = {LONG}')} SELECT day, product, timestamp, round(z, 6) AS z FROM z",
    "stride_sample": f"{T}, r AS (SELECT *, row_number() OVER ({P} {O}) - 1 AS k FROM c) SELECT day, product, timestamp, round(mid_price, 6) AS mid_price FROM r WHERE k % {STRIDE} = 0",
    "anchor_lag": f"""{T}, r AS (SELECT day, product, timestamp, row_number() OVER ({P} {O}) AS k, avg(mid_price) OVER ({P} {O} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS m, CAST(timestamp AS DOUBLE) - avg(timestamp) OVER ({P}) AS t,
 mid_price - avg(mid_price) OVER ({P}) AS y, avg(mid_price) OVER ({P}) AS my FROM c), f AS (SELECT day, product, regr_slope(y, t) AS b FROM r GROUP BY day, product)
SELECT day, product, count(*) AS n, round(avg(m - my - b * t), 6) AS mean_lag, round(stddev_pop(m - my - b * t), 6) AS std_lag FROM r JOIN f USING (day, product) WHERE k >= {W} GROUP BY day, product""",
    "family_ar1": f"""{PN}, x AS (SELECT day, family, product, mid_price AS y, lag(mid_price) OVER w AS p, avg(mid_price) OVER (PARTITION BY day, family, product) AS m FROM panel WINDOW w AS (PARTITION BY day, family, product ORDER BY timestamp))
SELECT day, family, product, count(*) AS n, CASE WHEN count(*) >= 3 AND max(p) > min(p) THEN round(regr_slope(y - m, p - m), 6) END AS phi FROM x GROUP BY day, family, product""",
    "iv_trend_mean": f"""{IV}, s AS (SELECT abs(regr_slope(iv, timestamp)) / avg(iv) AS v, count(*) AS n FROM iv GROUP BY day, strike)
SELECT count(*) AS series, round(avg(v) * 1e6, 4) AS per_million FROM s WHERE n >= 5""",
    "ranked_bots": f"{TT}{Z}{FEAT}{BUCK}{SCORE} SELECT horizon, CAST(row_number() OVER (PARTITION BY horizon ORDER BY score DESC, bot) AS INTEGER) AS rank, bot, round(score, 6) AS score FROM sc",
    "thin_scan": f"""SELECT scan, expiry, dispersion FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY expiry) - 1 AS i, first_value(expiry) OVER (PARTITION BY scan ORDER BY dispersion NULLS LAST, expiry) AS best
 FROM ({market_queries.SQL["expiry_scan"]}) s) x WHERE i % 5 = 0 OR expiry = best""",
    "stream_rolling_wide": f"{T} SELECT day, product, timestamp, count(*) OVER w AS n, round(sum(mid_price) OVER w, 3) AS total FROM c WINDOW w AS ({P} {O} ROWS BETWEEN {WIDE - 1} PRECEDING AND CURRENT ROW)",
    "stream_late_rows": f"""{T}, i AS (SELECT *, row_number() OVER ({P} {O}) AS k FROM c WHERE event_id % {LATE} <> 0), m AS (SELECT day, product, k, timestamp, mid_price AS ema FROM i WHERE k = 1
UNION ALL SELECT i.day, i.product, i.k, i.timestamp, 2.0 / 11 * i.mid_price + (1 - 2.0 / 11) * m.ema FROM m JOIN i ON i.day = m.day AND i.product = m.product AND i.k = m.k + 1)
SELECT day, product, timestamp, false AS late, round(ema, 6) AS ema FROM m UNION ALL SELECT day, product, timestamp, true, NULL FROM c WHERE event_id % {LATE} = 0""",
    "stream_day_end": f"""SELECT c.day, c.product, count(*) AS ticks, round(arg_min(mid_price, c.timestamp), 6) AS first, CAST(sum(CAST(drifting AS INT)) AS BIGINT) AS drifting, 0 AS entries_left
FROM ({ticks_queries.SQL["drift_monitor"]}) d JOIN ({T} SELECT day, product, timestamp, mid_price FROM c) c ON c.day = d.day AND c.product = d.product AND c.timestamp = d.timestamp GROUP BY c.day, c.product""",
    "option_quotes": f"{market_queries.QT} SELECT day, timestamp, CAST(strike AS INTEGER) AS strike, round(price, 6) AS price, round(spot, 6) AS spot FROM qq",
    "ranked_identities": f"""{market_queries.OTH}, a AS (SELECT family, product, {market_queries.REG.format(x="others")} AS r2 FROM o GROUP BY ALL)
SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY round(r2, 9) DESC, product) AS INTEGER) AS rank, product, round(r2, 6) AS r2 FROM a""",
    "ranked_leads": f"""{_wide_leads()} SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY round(abs(peak), 9) DESC, leader, follower) AS INTEGER) AS rank, leader, follower, peak_lag, round(peak, 6) AS peak FROM pk""",
    "pair_diagnostics_wide": _wide_pair(),
}
