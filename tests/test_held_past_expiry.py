"""Held options on a day whose last ticks are past their expiry: those ticks are part of the job."""

from pyspark.sql import functions as F

import compare
from tapeline import plans
from tapeline.operators import signals
from tapeline.plans import fixtures
from tests.test_quotes_past_expiry import tables  # noqa: F401


def test_excursion_counts_every_tick(spark, tables):  # noqa: F811
    path, con = tables
    every = fixtures.quotes(spark, path).select("day", "timestamp").distinct().groupBy("day").count()
    got = plans.QUERIES["exposure_excursion"](spark, path)
    assert {r.day: r.ticks for r in got.collect()} == {r.day: r["count"] for r in every.collect()}
    assert all(r.max_exposure > 0 and r.ticks_over < r.ticks for r in got.collect())
    rows, wrong = compare.difference(got, plans.SQL["exposure_excursion"], con)
    assert rows and not wrong


def test_hedges_have_every_tick(spark, tables):  # noqa: F811
    path, con = tables
    every = fixtures.quotes(spark, path).filter("strike = 10000").select("day", "timestamp", (F.col("tte") <= 0).alias("late"))
    got = plans.QUERIES["hedge_targets"](spark, path)
    assert got.count() == every.count()
    late = every.filter("late").join(got, ["day", "timestamp"])
    assert late.count() == late.filter("hedge = 0").count() > late.filter("option_buy = 0").count()
    rows, wrong = compare.difference(got, plans.SQL["hedge_targets"], con)
    assert rows and not wrong


def test_no_hedge_without_a_delta(spark):
    rows = [(0, 100, 10000.0, 10000, tte, 0, -3, 4, 5, 6) for tte in (1.0, 0.0, -0.1)]
    cols = "day int, timestamp long, spot double, strike int, tte double, option_position long, spot_position long, option_ask_volume long, spot_bid_volume long, spot_ask_volume long"
    got = signals.hedge_targets(spark.createDataFrame(rows, cols)).collect()
    assert [(r.option_buy, r.hedge) for r in got] == [(4, 1), (4, 0), (4, 0)]
