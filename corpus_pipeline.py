"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage reads all that the one before kept, and is written as Parquet before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import decontam, mixing, quality, sharding, simhash
from tapeline.llm.common import table, written
from tapeline.llm.queries import MIX, MIX_DEFAULT


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go. A null or empty text has too few words and goes; each of repeated
    rows is judged alike; ids play no part; other columns pass by under any names; an empty table stays empty."""
    return quality.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id stays (null ids come last; of rows with one id
    the first by fingerprint and text). Repeated rows are one; null and empty texts are one component; an empty table stays empty."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words from benchmark passages go. Null and empty texts have no words and stay;
    repeated rows are judged alike, whatever their ids; without a benchmark, or documents, nothing changes."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat to the target weights of their sources, in a global shuffle. A null source is the source '', a null id
    counts as ''; repeated rows get the same number of copies each; texts play no part; an empty table stays empty."""
    return mixing.mix_sources(docs, MIX, MIX_DEFAULT).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot, shards near equal in bytes; slots keep the mixed order. Equal texts, so copies too, share a
    shard and have a slot each; null texts are one group of a byte each; ties of groups go by their digests; an empty table gives none."""
    return sharding.shard_documents(docs, shards=16, in_order=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: XXH64 with a seed, the fingerprints' hash, has no SQL function; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
