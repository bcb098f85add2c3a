"""Tapes projected from the given tables, one SQL text each, valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import pricing

#: A row's number and running sum are those of its hour and the totals of the hours before, so that no
#: window holds a whole day.
TICKS = """
SELECT e.day, e.product, event_id, user_id,
       (rows_before + row_number() OVER (PARTITION BY e.day, e.product, e.hour ORDER BY ts, event_id) - 1) * 100 AS timestamp,
       CASE WHEN event_id % 97 = 0 THEN CAST(0.0 AS DOUBLE)
            ELSE CAST(10000 AS DOUBLE) + CAST(sum_before + sum(cents - 5000) OVER (PARTITION BY e.day, e.product, e.hour ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(1000 AS DOUBLE) END AS mid_price
FROM (SELECT event_id, user_id, ts, event_type AS product, date_trunc('hour', ts) AS hour,
             CAST(floor((day(ts) - 1) / 10.0) AS INT) AS day,
             CAST(round(value * 100) AS BIGINT) AS cents
      FROM events) e
JOIN (SELECT day, product, hour, CAST(coalesce(sum(n) OVER before, 0) AS BIGINT) AS rows_before, CAST(coalesce(sum(s) OVER before, 0) AS BIGINT) AS sum_before
      FROM (SELECT CAST(floor((day(ts) - 1) / 10.0) AS INT) AS day, event_type AS product, date_trunc('hour', ts) AS hour,
                   count(*) AS n, sum(CAST(round(value * 100) AS BIGINT) - 5000) AS s
            FROM events GROUP BY 1, 2, 3) g
      WINDOW before AS (PARTITION BY day, product ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h
  ON h.day = e.day AND h.product = e.product AND h.hour = e.hour
"""

TRADES = """
SELECT day, timestamp, product AS symbol,
       concat('U', CAST(user_id % 7 AS VARCHAR(8))) AS buyer,
       concat('U', CAST((user_id + 1 + event_id % 5) % 7 AS VARCHAR(8))) AS seller,
       mid_price + CAST((event_id % 5) - 2 AS DOUBLE) / CAST(2 AS DOUBLE) AS price,
       1 + event_id % 9 AS quantity
FROM ticks WHERE event_id % 3 = 0 AND mid_price > 0
"""

BOOK_LEVELS = """
SELECT day, product, l_orderkey AS order_id, level,
       CASE WHEN l_returnflag = 'A' AND level > 1 THEN NULL ELSE base + shift - 3 * level + l_suppkey % 2 END AS bid_price,
       CASE WHEN l_returnflag = 'A' AND level > 1 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS bid_volume,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE base + shift + 3 * level + l_partkey % 2 END AS ask_price,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(51 - l_quantity AS BIGINT) END AS ask_volume
FROM (SELECT l.*, l_orderkey % 3 AS day, 10000 + (l_orderkey * 7919) % 101 AS base, t.shift,
             concat(t.prefix, CAST(l_orderkey % 5 AS VARCHAR(8))) AS product,
             row_number() OVER (PARTITION BY l_orderkey, t.prefix
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS level
      FROM lineitem l CROSS JOIN (SELECT 'P' AS prefix, 0 AS shift UNION ALL SELECT 'T' AS prefix, 500 AS shift) t
      WHERE t.prefix = 'P' OR l_orderkey % 5 IN (0, 2)) x
WHERE level <= 3
"""

PANEL = """
SELECT year(m) AS day, (month(m) - 1) * 100 AS timestamp, n_regionkey AS family, n_nationkey AS product,
       CASE WHEN n_regionkey = 0 AND n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey)
            THEN CAST(500000000 - (sum(cents) OVER (PARTITION BY m, n_regionkey) - cents) AS DOUBLE) / CAST(100 AS DOUBLE)
            ELSE CAST(cents AS DOUBLE) / CAST(100 AS DOUBLE) END AS mid_price
FROM (SELECT g.m, g.n_regionkey, g.n_nationkey, CAST(coalesce(s.cents, 0) AS BIGINT) AS cents
      FROM (SELECT m, n_regionkey, n_nationkey
            FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders) mm CROSS JOIN nation) g
      LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS m, c_nationkey,
                        sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
                 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) s
        ON s.m = g.m AND s.c_nationkey = g.n_nationkey) z
"""

QUOTE_INPUTS = """
SELECT t.day, t.timestamp, t.event_id, t.mid_price AS spot, k.strike,
       CAST(8.25 AS DOUBLE) - t.day - CAST(t.timestamp AS DOUBLE) / CAST(1000000 AS DOUBLE) AS tte,
       CAST(24 + (t.event_id % 7) - 3 AS DOUBLE) / CAST(2000 AS DOUBLE) AS true_vol,
       (t.event_id % 53 = 0) AS below_intrinsic
FROM ticks t CROSS JOIN (SELECT 9700 AS strike UNION ALL SELECT 9800 UNION ALL SELECT 9900
                         UNION ALL SELECT 10000 UNION ALL SELECT 10100 UNION ALL SELECT 10200) k
WHERE t.product = 'view' AND t.mid_price > 0
"""


def _run(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name} ", f"{word} {{{name}}} ").replace(f"{word} {name}\n", f"{word} {{{name}}}\n").replace(f"{word} {name})", f"{word} {{{name}}})")
    return spark.sql(text, **tables)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, TICKS, events=_table(spark, sf_dir, "events"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, TRADES, ticks=ticks(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, PANEL, **{t: _table(spark, sf_dir, t) for t in ("orders", "nation", "customer")})


def book_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as rows of a price tape; timestamp is the order's number times 100."""
    long = _run(spark, BOOK_LEVELS, lineitem=_table(spark, sf_dir, "lineitem"))
    at = lambda c, k: F.max(F.when(F.col("level") == k, F.col(c)))
    cells = [at(f"{side}_{what}", k).alias(f"{side}_{what}_{k}") for side in ("bid", "ask") for k in (1, 2, 3) for what in ("price", "volume")]
    return long.groupBy("day", "product", (F.col("order_id") * 100).alias("timestamp")).agg(*cells)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option quotes at the price of their true volatility; some are below their intrinsic value."""
    rows = _run(spark, QUOTE_INPUTS, ticks=ticks(spark, sf_dir))
    fair = pricing.call_price(F.col("spot"), F.col("strike").cast("double"), F.col("tte"), F.col("true_vol"))
    bad = F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0)) - 0.5
    return rows.withColumn("price", F.when(F.col("below_intrinsic"), bad).otherwise(fair))


def strike_spreads(q: DataFrame) -> DataFrame:
    """day, strike, mean_spread of the quotes: 1 for the lowest strike and half a point more for each."""
    return q.groupBy("day", "strike").agg(F.avg(F.lit(1.0) + (F.col("strike") - 9700) / F.lit(200.0)).alias("mean_spread"))
