"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with weight w and n documents has the mean repetition rate w / sum(w) * epochs * N / n.
Each document's number of copies is a Poisson variate of that mean, inverted from a uniform number
that a hash of (seed, doc_id, part) gives. A rate above PART is a sum of independent parts of at
most PART each, so that exp(-rate) never underflows and one table of PART_TERMS terms is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

PART, PART_TERMS = 8.0, 64


def uniform(*parts: Column) -> Column:
    """In [0, 1): 52 bits of an MD5 over the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _key(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, epochs: float) -> DataFrame:
    """source, parts, and the cumulated Poisson probabilities of one part. Null is the source ''."""
    named = F.lit(float(default_weight))
    for name, weight in weights.items():
        named = F.when(F.col("mix_source") == name, F.lit(float(weight))).otherwise(named)
    counts = docs.groupBy(_key(F.col("source")).alias("mix_source")).agg(F.count("*").alias("n")).withColumn("w", named)
    sums = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.col("w") / F.col("all_w") * F.lit(float(epochs)) * F.col("all_n") / F.col("n")
    rates = counts.crossJoin(sums).withColumn("rate", rate)  # sums is one row
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    one = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("cdf"))

    def term(acc: Column, k: Column) -> Column:
        p = acc["p"] * one / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(PART_TERMS)), start, term)["cdf"]
    return rates.select("mix_source", "rate", "parts", cdf.alias("cdf"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17
) -> DataFrame:
    """docs repeated to the target weights and globally shuffled; adds copies, replica, shuffle_key.

    docs: doc_id, source and any others, of any names; columns named like the added ones are replaced. Sources
    without a weight have default_weight; a source of weight 0 vanishes. A null source is the source
    ''. A null doc_id counts as ''. Repeated rows with one id get the same count each. An empty table
    stays empty. Rows leave in the order of shuffle_key, a hash of id and replica.
    """
    own = [c for c in docs.columns if c.lower() not in ("copies", "replica", "shuffle_key")]
    rates = written(source_rates(docs.select("source"), weights, default_weight, epochs), "rates")
    seeded = F.lit(str(seed))
    rates = rates.select("mix_source", F.col("parts").alias("mix_parts"), F.col("cdf").alias("mix_cdf"))

    def drawn(part: Column) -> Column:
        u = uniform(seeded, _key(F.col("mix_id")), part.cast("string"))
        return F.size(F.filter("mix_cdf", lambda c: c <= u))

    # the rates were written: Spark knows their size and broadcasts them only below its threshold
    mixed = docs.select(F.struct(*own).alias("mix_row"), F.col("doc_id").alias("mix_id"), _key(F.col("source")).alias("mix_source")).join(rates, "mix_source")
    copies = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("mix_parts") - 1), drawn), F.lit(0), lambda a, n: a + n)
    mixed = mixed.withColumn("copies", copies).filter("copies > 0")
    mixed = mixed.select("mix_row", "mix_id", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica"))
    key = F.md5(F.concat_ws(":", F.lit("order"), seeded, _key(F.col("mix_id")), F.col("replica").cast("string")))
    mixed = mixed.withColumn("shuffle_key", key)
    # keys are even, so their ranges are known: no sample is drawn to find them, and rows are made once
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = (F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * parts).cast("int")
    mixed = mixed.repartitionById(parts, place).sortWithinPartitions("shuffle_key")
    return mixed.select(*[F.col("mix_row").getField(c).alias(c) for c in own], "copies", "replica", "shuffle_key")
