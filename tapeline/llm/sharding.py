"""Balanced shards by longest-processing-time scheduling.

Groups that must stay together are taken from the largest to the smallest, and each goes to the
shard with the least load, read from a heap. One heap for all groups would pass the whole corpus
through one process, so groups are first summed into size classes of `PRECISION` significant bits
(at most 64 * 2**PRECISION classes at any input size). The driver schedules classes: equal items
of a class are dealt out in bulk up to the level that the heap would reach, the rest by the heap.
Ranks inside a class then say which group goes where.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Significant bits of a size class; sizes below 2**PRECISION are exact.
PRECISION = 10


def size_class(size: Column) -> Column:
    """size with all but its first PRECISION bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - F.lit(PRECISION), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """For each class (key, groups, total size), largest first: how many groups each shard gets.

    As a heap that takes one group at a time would deal them, with the class's mean size.
    """
    load, dealt = [0.0] * shards, {}
    for key, count, total in sorted(classes, reverse=True):
        each, given = total / count, [0] * shards
        left = count
        if left > 4 * shards and each > 0:
            # the level up to which all shards fill before `left` runs out, less a round
            lows, level = sorted(load), 0.0
            for n in range(1, shards + 1):
                level = (sum(lows[:n]) + left * each) / n
                if n == shards or level <= lows[n]:
                    break
            for i in range(shards):
                given[i] = max(0, int((level - load[i]) / each) - 1)
            left -= sum(given)
        heap = [(load[i] + given[i] * each, i) for i in range(shards)]
        heapq.heapify(heap)
        for _ in range(left):
            low, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (low + each, i))
        load = [load[i] + given[i] * each for i in range(shards)]
        dealt[key] = given
    return dealt


def assign(groups: DataFrame, shards: int, cells: int) -> DataFrame:
    """shard of each row (group binary, size long) of groups, one row a group."""
    spark = groups.sparkSession
    marked = groups.select(
        "group", "size", size_class(F.col("size")).alias("cls"), F.pmod(F.xxhash64("group"), F.lit(cells)).alias("cell")
    )
    tally = written(marked.groupBy("cls", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "cells")
    # at most 64 * 2**PRECISION rows, whatever the input
    classes = [tuple(r) for r in tally.groupBy("cls").agg(F.sum("n"), F.sum("total")).collect()]
    runs = []
    for key, given in schedule(classes, shards).items():
        upto = 0
        for shard, n in enumerate(given):
            if n:
                upto += n
                runs.append((key, upto, shard))
    plan = spark.createDataFrame(runs or [(0, 0, 0)], "cls long, upto long, shard int")
    plan = plan.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan"))
    # each class has at most `cells` rows here
    before = Window.partitionBy("cls").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("cls", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = offsets.join(plan, "cls")  # at most a row a class, whatever the input
    inside = F.row_number().over(Window.partitionBy("cls", "cell").orderBy("group"))
    return (
        marked.withColumn("rank", inside)
        .join(offsets, ["cls", "cell"])
        .withColumn("place", F.col("before") + F.col("rank"))
        .select("group", F.get(F.filter("plan", lambda p: p["upto"] >= F.col("place")), F.lit(0))["shard"].alias("shard"))
    )


def shard_documents(docs: DataFrame, shards: int = 16, cells: int = 256, in_order: bool = False) -> DataFrame:
    """A shard for each document, with equal texts together and the shards' bytes near equal.

    docs: doc_id, text; other columns are ignored. Law: `bytes`. size: UTF-8 bytes of the text plus
    1. Null texts count as 1 byte, have the checksum of no bytes, and form one group of their own.
    Repeated rows are equal texts, hence together; each has its own slot. Null ids come first in
    a cell. An empty table gives an empty result. cells: into how many parts each class and each
    shard is cut for ranking. in_order: a shard's slots follow the order in which docs is read, so that
    documents that were mixed stay so; else they follow a hash of id and text.
    """
    rows = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.coalesce(F.sha2("text", 256), F.lit(""))).alias("group"), F.monotonically_increasing_id().alias("read"),
        ),
        "sized",
    )
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size")), "groups")
    placed = rows.join(written(assign(groups, shards, cells), "placed"), "group")
    # the upper bits of `read` are the partition that the row was read in
    cell = F.shiftright("read", 33) if in_order else F.pmod(F.xxhash64("doc_id", "group"), F.lit(cells))
    placed = placed.withColumn("cell", cell)
    placed = written(placed, "sharded")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*(["read"] if in_order else ["doc_id", "group"])))
    return (
        placed.withColumn("rank", inside)
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
