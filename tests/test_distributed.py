"""Operators that cut series into parts: equal to the plain whole-series form, also where parts are tiny."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.functions import pricing
from tapeline.functions.stats import about_mean, line, moments
from tapeline.operators import asof, bootstrap, cross, flow, options, quantiles, regime, series
from tests.test_market import col, ticks, walk

AT = (0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("small, parts", [(200_000, 4096), (10, 4096), (3, 4), (1, 2)])
def test_quantiles_equal_a_sort(spark, monkeypatch, small, parts):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    draw = random.Random(small)
    values = {
        "wide": [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(60)], "ties": [float(draw.randrange(3)) for _ in range(80)],
        "one": [4.0], "zeros": [0.0, -0.0, 0.0], "close": [1.0 + k * 2.0**-52 for k in range(40)], "odd": [math.inf, -math.inf, 5e-324, -5e-324, 0.0, 1.0], None: [2.0, 3.0],
    }
    rows = [(k, draw.randrange(3), x) for k, v in values.items() for x in v] + [("ties", 1, None), ("none", 0, None)]
    frame = spark.createDataFrame(rows, "k string, day int, x double")
    got = {r.k: (r.n, r.p) for r in quantiles.quantiles(frame, F.col("x"), AT, ["k"]).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        order = sorted(v)
        for p, x in zip(AT, got[k][1]):
            low, share = int(p * (len(v) - 1)), p * (len(v) - 1) - int(p * (len(v) - 1))
            a, b = order[low], order[min(low + 1, len(v) - 1)]
            want = a if share == 0 or a == b else (1 - share) * a + share * b
            assert x == want or math.isclose(x, want, rel_tol=1e-12), (k, p)
        assert got[k][0] == len(v)
    held = quantiles.quantiles(frame.filter("k IN ('ties', 'one', 'close')"), F.col("x"), [0.25, 0.9], ["k"], "day").collect()
    want = {}
    for k, day in itertools.product(("ties", "one", "close"), range(3)):
        if rest := [x for kk, d, x in rows if kk == k and d != day and x is not None]:
            want[k, day] = (len(rest), *np.quantile(rest, [0.25, 0.9]))
    assert {(r.k, r.held_out) for r in held} == set(want)
    for r in held:
        assert (r.n, *r.p) == pytest.approx(want[r.k, r.held_out], rel=1e-12)
    (one,) = quantiles.quantiles(frame.filter("k = 'ties'"), F.col("x"), [0.5]).collect()
    assert one.n == 80 and one.p == [statistics.median(values["ties"])]
    (none,) = quantiles.quantiles(frame.filter("k = 'none'"), F.col("x"), [0.5]).collect()
    assert none.p is None


@pytest.mark.parametrize("sliding", [64, 1])
def test_rolling_with_nulls(spark, sliding):
    v = [None, 1.0, 2.0, None, 4.0, 5.0, 6.0, None, None, None, 7.0, 7.0, None, 7.0]
    got = series.rolling(ticks(spark, v), "mid_price", 3, sliding=sliding).orderBy("timestamp").collect()
    for i, r in enumerate(got):
        w = [x for x in v[max(0, i - 2) : i + 1] if x is not None]
        assert r.roll_n == len(w)
        assert r.roll_mean is None if not w else math.isclose(r.roll_mean, statistics.fmean(w), abs_tol=1e-12)
        assert r.roll_std is None if len(w) < 2 else math.isclose(r.roll_std, statistics.pstdev(w), abs_tol=1e-9)
    assert got[-1].roll_std == 0.0


@pytest.mark.parametrize("span", [100, 300, 1 << 40])
@pytest.mark.parametrize("tolerance", [None, 250])
def test_asof_in_spans(spark, span, tolerance):
    draw = random.Random(span)
    rows = [(k, draw.randrange(60) * 50, i) for k in "ab" for i in range(80)]
    events = [(k, draw.randrange(8, 30) * 50, t, f"v{t}") for k in "ac" for t in range(12)]
    left = spark.createDataFrame(rows, "k string, t long, i long")
    right = spark.createDataFrame(events, "k string, t long, tie long, v string")
    found = asof.latest(left, right, ["k"], "t", F.col("v"), "tie", tolerance, span=span).collect()
    assert len(found) == len(rows)
    for r in found:
        near = [e for e in events if e[0] == r.k and e[1] <= r.t and (tolerance is None or r.t - e[1] <= tolerance)]
        best = max(near, key=lambda e: (e[1], e[2]), default=None)
        assert (r.event and tuple(r.event)) == (best and (best[1], best[3]))
    fills = spark.createDataFrame([(k, t, q) for k, t, _, _ in events for q in (3, -1)], "k string, timestamp long, signed long")
    held = asof.positions(fills, left.withColumnRenamed("t", "timestamp"), ["k"], span=span).collect()
    for r in held:
        assert r.position == sum(2 for e in events if e[0] == r.k and e[1] <= r.timestamp)


def test_anchor_by_two_aggregations(spark):
    v = [100.0, 101.0, 130.0, 100.0]
    got = series.start_anchor(ticks(spark, v).unionByName(ticks(spark, [5.0], 0, "B")), "mid_price", 0.01, 20.0)
    assert col(got.filter("product = 'A'"), "halted") == [False, False, True, True] and col(got.filter("product = 'A'"), "fair") == [100.0, 101.0, 102.0, 103.0]
    assert col(got.filter("product = 'B'"), "halted") == [False]


@pytest.mark.parametrize("n, length", [(1, 4), (3, 4), (4, 4), (37, 5), (40, 8)])
def test_block_sums_in_parts(spark, n, length):
    v = walk(n, 3)
    y = [x - v[0] for x in v]
    m = -(-n // length)
    tail = n - (m - 1) * length
    for span, part in ((500, 8), (1 << 40, 1 << 20)):
        got = bootstrap.block_sums(ticks(spark, v), "mid_price", ["day", "product"], "timestamp", length, span, part).collect()
        assert sorted(r.s for r in got) == list(range(n))
        for r in got:
            for name, size in (("full", min(length, n)), ("last", tail)):
                block = [y[(r.s + k) % n] for k in range(size)]
                want = (sum(block), sum(x * x for x in block), sum(k * x for k, x in enumerate(block)))
                assert (r[f"{name}1"], r[f"{name}2"], r[f"{name}j"]) == pytest.approx(want, abs=1e-8)


def _legs(spark, rows):
    return spark.createDataFrame(rows, "day int, horizon int, bucket int, bot string, direction int, product string, timestamp long, favourable double")


def test_a_horizon_draws_from_its_own_days(spark):
    """The long horizon has no leg on the short last day: its scores are the same in every resample of the two days that it has."""
    rows = [(d, h, 0, bot, 1, "A", 100 * i, x) for d, h in ((0, 1), (1, 1), (2, 1), (0, 9), (1, 9)) for bot, x in (("x", 1.0), ("y", -1.0)) for i in range(3)]
    sums = flow.leg_sums(_legs(spark, rows))
    found = {(r.horizon, r.bot): r for r in flow.day_bootstrap(sums, 300, 5).collect()}
    assert found[9, "x"].ci_low == found[9, "x"].ci_high == found[9, "x"].score == 2.0
    assert found[9, "x"].floored and found[1, "x"].ci_low == 2.0
    draws = bootstrap.unit_draws(sums.select("horizon", "day").distinct(), "day", 300, 5, ("horizon",))
    count = {(r.horizon, r.replicate): r["count"] for r in draws.groupBy("horizon", "replicate").count().collect()}
    assert set(count.values()) == {2, 3} and all(n == (3 if h == 1 else 2) for (h, _), n in count.items())
    assert {r.day for r in draws.filter("horizon = 9").collect()} == {0, 1}


def test_trade_bootstrap_is_that_of_the_mean(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(0.5, 2.0, 400)
    rows = [(0, 5, 0, "u", 1, "A", 100 * i, float(v)) for i, v in enumerate(x)] + [(0, 5, 0, "w", 1, "B", 0, 0.0)]
    legs = _legs(spark, rows)
    (found,) = flow.trade_bootstrap(legs, flow.leg_sums(legs), "u", 5, 1000, 3).collect()
    again = np.quantile([draw.choice(x, len(x)).mean() for _ in range(4000)], [0.025, 0.975])
    assert found.n == 400 and found.score == pytest.approx(x.mean()) and (found.ci_low, found.ci_high) == pytest.approx(again, abs=0.05)
    (weights,) = spark.range(1).select(bootstrap.poisson_weights(1, F.lit("k"), 4001).alias("w")).collect()
    assert len(weights.w) == 4001 and np.mean(weights.w) == pytest.approx(1, abs=0.06) and np.var(weights.w) == pytest.approx(1, abs=0.1)
    (same,) = spark.range(1).select(bootstrap.poisson_weights(1, F.lit("k"), 7).alias("w")).collect()
    assert same.w == weights.w[:7]


def test_greedy_pairs_one_by_one(spark):
    draw = random.Random(8)
    edges = [(g, a, b, draw.choice([0.1, 0.5, -0.5, 0.9])) for g in (1, 2) for a, b in itertools.combinations(range(7), 2)] + [(3, 0, 1, 0.2), (3, 1, 0, 0.2)]
    want = []
    for g in (1, 2, 3):
        taken = set()
        for _, a, b, w in sorted((e for e in edges if e[0] == g and e[1] < e[2]), key=lambda e: (-abs(e[3]), e[1], e[2])):
            if not taken & {a, b}:
                taken |= {a, b}
                want.append((g, a, b, w))
    frame = spark.createDataFrame(edges, "group int, a int, b int, weight double")
    assert sorted(map(tuple, cross.greedy_pairs(frame).collect())) == sorted(want)
    assert cross.greedy_pairs(frame.filter("false")).count() == 0


def test_moments_of_days_add_up(spark):
    """Values far from zero: sums about the days' means, moved to the common one, give the fit of the whole."""
    draw = np.random.default_rng(2)
    x = 1e8 + draw.normal(0, 1, 90)
    y = 3 * x + draw.normal(0, 0.1, 90)
    frame = spark.createDataFrame([("k", i % 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("k", 0, None, 1.0), ("c", 0, 0.1 + 0.2, 1.0), ("c", 1, 0.3, 2.0)], "k string, day int, x double, y double")
    stats = about_mean(frame.groupBy("k", "day").agg(*moments(F.col("x"), F.col("y"))), ["k"])
    slope, _, r2 = line()
    whole = stats.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).select("k", "n", slope.alias("slope"), r2.alias("r2"))
    found = {r.k: r for r in whole.collect()}
    assert found["k"].n == 90 and found["k"].slope == pytest.approx(np.polyfit(x - 1e8, y - 3e8, 1)[0], rel=1e-6)
    assert found["k"].r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, rel=1e-6) and found["c"].slope == 0.0


def test_one_solve_serves_all_expiries(spark):
    quotes = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS day", "id * 100 AS timestamp", "CAST(9800 + 50 * (id % 9) AS INT) AS strike", "CAST(10000 AS DOUBLE) AS spot", "IF(id = 7, -1.0D, IF(id = 8, 20000.0D, 5.0D + 11 * id)) AS price")
    grid = [3.0, 8.25, 40.0]
    own = options._by_expiry(quotes, grid, 1)
    each = quotes.crossJoin(spark.createDataFrame([(g,) for g in grid], "expiry double")).withColumn("tte", F.col("expiry") - F.col("day") - F.col("timestamp") / 1e6)
    each = each.withColumn("want", pricing.implied_vol(F.col("price"), F.col("spot"), F.col("strike").cast("double"), F.col("tte"))).filter("want IS NOT NULL")
    keys = ["day", "timestamp", "strike", "expiry"]
    a = {tuple(r[k] for k in keys): r.iv for r in own.collect()}
    b = {tuple(r[k] for k in keys): r.want for r in each.collect()}
    assert a.keys() == b.keys() and len(a) > 50 and all(abs(a[k] - b[k]) <= 1e-6 for k in a)


def test_leave_one_out_by_counts(spark):
    frame = ticks(spark, walk(60, 2)).unionByName(ticks(spark, walk(50, 3), 1)).unionByName(ticks(spark, walk(40, 5), 2)).unionByName(ticks(spark, [1.0], 3, "B"))
    found = {(r["product"], r.held_out, r.percentile): (r.n, r.abs_z) for r in regime.leave_one_out_percentiles(frame, "mid_price", 5).collect()}
    z = series.zscore(frame, "mid_price", 5).filter("z IS NOT NULL").select("day", F.abs("z").alias("z")).collect()
    for held in range(4):
        rest = [r.z for r in z if r.day != held]
        for p in regime.TIERS:
            assert found["A", held, p] == (len(rest), pytest.approx(np.quantile(rest, p / 100), rel=1e-9))
    assert len(found) == 4 * len(regime.TIERS)


def test_no_window_holds_a_whole_key(spark):
    """The plans of the span forms have no window by the key alone over rows of the series."""
    rows = ticks(spark, walk(50))
    events = rows.filter("timestamp % 700 = 0")
    for made in (asof.latest(rows, events, ["day", "product"], "timestamp", F.col("mid_price")), bootstrap.block_sums(rows, "mid_price", ["day", "product"], "timestamp", 5)):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line_ for line_ in text.splitlines() if "Window [" in line_]
        assert windows and all("_span" in w or "_part" in w for w in windows)
    assert not [line_ for line_ in series.start_anchor(rows, "mid_price", 0.0, 5.0)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line_]


def test_jumps_in_blocks(spark, monkeypatch):
    from tapeline.operators import jumps

    v = walk(200, 11)
    v[60] += 40
    v[130] -= 55
    frame = ticks(spark, v).unionByName(ticks(spark, walk(30, 2), 1))
    plain = jumps.flagged(frame, 8, 2.0, 5.0, 1.0)
    monkeypatch.setattr(jumps, "LENGTH", 10)
    monkeypatch.setattr(series, "SPAN", 900)
    cut = series.in_blocks(frame, lambda rows, keys: rows, 1, 10, 900)
    assert cut.count() == frame.count()
    parts = jumps.flagged(frame, 8, 2.0, 5.0, 1.0)
    assert sorted(map(str, plain.collect())) == sorted(map(str, parts.collect())) and plain.filter("big").count() > 3
    change = [b - a for a, b in zip(v, v[1:])]
    rows = {r.timestamp: r for r in parts.filter("day = 0").collect()}
    assert len(rows) == 199 and rows[100].prior is None
    for i in range(1, 199):
        r = rows[100 * (i + 1)]
        assert r.change == change[i] and r.prior.change == change[i - 1] and r.prior.big == rows[100 * i].big
        w = change[max(0, i - 7) : i + 1]
        assert r.big == (i >= 7 and statistics.pstdev(w) > 0 and abs(change[i]) >= 2.0 * statistics.pstdev(w))


@pytest.mark.parametrize("length", [4096, 7, 2, 1])
def test_lag_sums_in_blocks(spark, length):
    """Series of unequal lengths against a plain double loop; a row is shuffled once and for the blocks that its lags reach."""
    series_ = {"a": walk(40, 1), "b": walk(33, 2), "c": walk(2, 3)}
    rows = [(day, 100 * i, 1, p, x + day * (i % 3)) for p, v in series_.items() for day in (0, 1) for i, x in enumerate(v)]
    panel = spark.createDataFrame(rows, "day int, timestamp long, family int, product string, mid_price double")
    found = cross.lag_sums(panel, [-3, 0, 5], length)
    assert "Generate explode([-3,0,5]" not in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()
    got = {(r.leader, r.follower, r.lag, r.day): (r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy) for r in found.collect()}
    change = {(d, p): [b - a for a, b in itertools.pairwise([r[4] for r in rows if (r[0], r[3]) == (d, p)])] for d in (0, 1) for p in series_}
    want = {}
    for (d, p), v in change.items():
        for q in series_:
            w = change[d, q]
            for lag in (-3, 0, 5) if p != q else ():
                if pairs := [(x, w[i + lag]) for i, x in enumerate(v) if 0 <= i + lag < len(w)]:
                    x, y = zip(*pairs)
                    want[p, q, lag, d] = (len(x), sum(x), sum(y), sum(a * a for a in x), sum(b * b for b in y), sum(a * b for a, b in pairs))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
