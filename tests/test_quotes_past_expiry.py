"""Queries over quotes against their SQL on a day whose last ticks are past the options' expiry."""

import pytest
from pyspark.sql import functions as F

import compare
from tapeline import plans
from tapeline.plans import fixtures

NAMES = (
    "option_quotes",
    "bs_price_delta_vega",
    "level_regression",
    "implied_vol",
    "smile",
    "iv_reversion",
    "iv_trend",
    "iv_trend_mean",
    "pair_edges",
    "single_edges",
    "net_exposure",
    "exposure_excursion",
    "hedge_targets",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Day 3 has 52,600 ticks; its options expire with the 52,500th."""
    path = str(tmp_path_factory.mktemp("late"))
    i = F.col("id")
    value = F.round(50 + F.when(i % 2 == 0, 1).otherwise(-1) * (i % 89) / 10 + (i % 7 - 3) / 100, 2)
    ts = F.timestamp_micros(F.lit(1_706_659_200_000_000) + i * 1_000_000)  # the 31st
    rows = spark.range(52_600).select(i.alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), (i % 50).alias("user_id"), F.lit("view").alias("event_type"), value.cast("double").alias("value"))
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    con = compare.duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return path, con


def test_some_quotes_are_past_expiry(spark, tables):
    q = fixtures.quotes(spark, tables[0])
    assert 0 < q.filter("tte <= 0").count() < q.filter("tte > 0").count()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    path, con = tables
    rows, wrong = compare.difference(plans.QUERIES[name](spark, path), plans.SQL[name], con)
    assert rows and not wrong
