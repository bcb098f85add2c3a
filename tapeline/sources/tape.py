"""Price and trade tapes: delimited files, partitioned Parquet, streams, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.schema import PRICES, TRADES


class TapeError(ValueError):
    """A tape that breaks its contract."""


def _delimited(spark: SparkSession, path, schema: T.StructType, delimiter: str) -> DataFrame:
    """All columns as strings. Wrong headers and rows of a wrong length raise: the header is checked
    against the schema, and no column is pruned from the parser."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.read.schema(text).option("sep", delimiter).option("header", True).option("enforceSchema", False).option("columnPruning", False)
    df = reader.option("mode", "FAILFAST").csv(path)
    if df.isEmpty():
        raise TapeError(f"no rows in {path}")
    return df


def read_prices(spark: SparkSession, path, delimiter: str = ";") -> DataFrame:
    """Integers must parse; prices and volumes that don't are null."""
    df = _delimited(spark, path, PRICES, delimiter)
    loose = lambda f: F.col(f.name).try_cast(f.dataType) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast(f.dataType)
    return df.select(*[loose(f).alias(f.name) for f in PRICES])


def read_trades(spark: SparkSession, path, delimiter: str = ";") -> DataFrame:
    """All numbers must parse; blank names stay empty strings."""
    df = _delimited(spark, path, TRADES, delimiter)
    return df.select(*[(F.coalesce(F.col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in TRADES])


def write_tape(df: DataFrame, path: str, round_number: int) -> None:
    """Into path/round=/day=; the partitions that df has are replaced, others stay."""
    rows = df.withColumn("round", F.lit(round_number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round", "day").parquet(path)


def read_tape(spark: SparkSession, path: str, round_number: int, days: list[int] | None = None) -> DataFrame:
    """Filters on round and day prune partitions."""
    rows = spark.read.parquet(path).filter(F.col("round") == round_number)
    return rows if days is None else rows.filter(F.col("day").isin(days))


def stream_prices(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(PRICES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def product_sets(prices: DataFrame) -> DataFrame:
    """Per day: ticks, products, and missing: products that other days have."""
    days = prices.groupBy("day", "product").agg(F.count("*").alias("ticks"))
    every = days.select("product").distinct()
    pairs = days.select("day").distinct().crossJoin(every)
    joined = pairs.join(days, ["day", "product"], "left")
    return joined.groupBy("day").agg(
        F.coalesce(F.sum("ticks"), F.lit(0)).alias("ticks"), F.count("ticks").alias("products"),
        F.sum(F.col("ticks").isNull().cast("long")).alias("missing"),
    )


def validate(prices: DataFrame, expected_days: list[int] | None = None) -> DataFrame:
    """prices, or TapeError if days differ in products or an expected day is missing."""
    sets = product_sets(prices)
    bad = [r.day for r in sets.filter("missing > 0").collect()]  # one row a day at most
    if bad:
        raise TapeError(f"days {sorted(bad)} lack products of other days")
    if expected_days is not None and (gone := set(expected_days) - {r.day for r in sets.select("day").collect()}):
        raise TapeError(f"days {sorted(gone)} are missing")
    return prices


def aligned(prices: DataFrame) -> DataFrame:
    """Per (day, timestamp) that isn't one row for each product: rows, products."""
    n = prices.agg(F.countDistinct("product").alias("all"))
    ticks = prices.groupBy("day", "timestamp").agg(F.count("mid_price").alias("rows"), F.countDistinct("product").alias("products"))
    return ticks.crossJoin(F.broadcast(n)).filter("rows <> all OR products <> all").drop("all")  # n is one row
