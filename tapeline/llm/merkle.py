"""A Merkle manifest of the documents: digests, a content-addressed store of inner nodes, and proofs.

Each document is a leaf. Per language the leaves, in the order of their ids, are hashed together in runs
of FANOUT until one node remains; those subroots are hashed likewise to the root. Every inner node is a
record, digest -> digests of its children, and proofs are read from the records alone: all leaf
requests descend from the root together, by the digits of their ranks; requests that share a prefix share a row. At each
record they collect the children not taken as a segment of their path. The segments, which come from the root
downwards, are reversed at the leaf.

Texts are hashed where they are read and never shuffled. Ranks come from one range sort of (language, id,
digest), written once, and counts per part. Records are joined by digest and place, so that
a digest that repeats a million times (repeated rows) is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, written

FANOUT = 8
#: The key of the tree over the languages' subroots. Languages have keys '' (null) and '=' + lang.
TOP = "*"


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 bytes, counted."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and fake of each document; fake is the digest of the tampered row, null if none is tampered.

    A row is tampered with where 3 divides the CRC-32 of its id in decimals: A-Z of its text become a-z. A null id
    has no decimals and is left alone.
    """
    head = [encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), "doc_id",
        digest(*head, encoded(F.col("text"))).alias("leaf"),
        F.when(chosen, digest(*head, encoded(ascii_lower(F.col("text"))))).alias("fake"),
    )


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their rank (from 0) in the order of these columns inside their tree, nulls first, and the tree's
    height: in how many rounds one node remains.

    One range sort; its partitions are written with the place of each row, counted, and the counts added up. Equal
    rows are told apart by where they were read, so they spread over partitions as well.
    """
    sorts = ["tree", *order, "read"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.columns
    rows = rows.withColumn("read", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *sorts).sortWithinPartitions(*sorts).drop("read")
    place = F.monotonically_increasing_id()
    rows = written(rows.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND((1 << 33) - 1)), name)
    counts = written(rows.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")), "counts")
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rounds = reduce(Column.__add__, [(F.col("all") > FANOUT**k).cast("int") for k in range(21)])
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("tree")))
    counts = counts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), rounds.alias("height"))
    counts = broadcast_if_small(written(counts, "shifts"), F.octet_length("tree") + 32)
    return rows.join(counts, ["tree", "part"]).select(*own, (F.col("at") + F.col("shift")).alias("rank"), "height")


def _record(nodes: DataFrame, more: list[str]) -> DataFrame:
    """Runs of FANOUT nodes (tree, rank, node, height): tree, rank, children, node (their digest), height, and
    the leaves' own columns `more` as requests."""
    parent = F.floor(F.col("rank") / FANOUT).cast("long")
    run = F.sort_array(F.collect_list(F.struct("rank", "node", *more)))
    runs = nodes.groupBy("tree", parent.alias("rank")).agg(run.alias("run"), F.max("height").alias("height"))
    kept = [F.transform("run", lambda x: F.struct(*[x[c].alias(c) for c in more])).alias("requests")] if more else []
    return runs.select("tree", "rank", F.col("run.node").alias("children"), F.sha2(F.array_join("run.node", ""), 256).alias("node"), "height", *kept)


def _levels(nodes: DataFrame, more: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The records of all trees, a table for each level from the leaves upwards, and each tree's root (tree, node, height)."""
    levels, roots = [], [nodes.filter("height = 0").select("tree", "node", "height")]
    for level in range(nodes.agg(F.max("height")).first()[0] or 0):
        nodes = written(_record(nodes.filter(F.col("height") > level), more if level == 0 else []), "level")
        levels.append(nodes)
        roots.append(nodes.filter(F.col("height") == level + 1).select("tree", "node", "height"))
    return levels, reduce(DataFrame.unionByName, roots)


def _fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the segments of its path, from the leaf upwards."""
    def up(node: Column, step: Column) -> Column:
        left, right = F.slice(step["others"], F.lit(1), step["digit"]), F.slice(step["others"], step["digit"] + 1, F.lit(FANOUT))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(path, leaf, up)


def _down(frontier: DataFrame, records: DataFrame, *more: str) -> DataFrame:
    """Each row's record, found by its digest and place, and one row for each child with the children not taken as a new segment."""
    met = frontier.join(records.select("tree", "rank", "node", "children", *more), ["tree", "rank", "node"])
    each = met.select("*", F.posexplode("children").alias("digit", "child"))
    digit = F.col("digit")
    others = F.concat(F.slice("children", F.lit(1), digit), F.slice("children", digit + 2, F.lit(FANOUT)))
    step = F.array(F.struct(digit.alias("digit"), others.alias("others")))
    # segments from the root downwards; reversed where the leaf is reached
    return each.select("tree", (F.col("rank") * FANOUT + digit).alias("rank"), F.col("child").alias("node"), F.concat("path", step).alias("path"), "subroot", *[F.get(m, digit).alias("request") for m in more])


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, path (from the leaf upwards), proof_sha256, folded_root, verified.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. Nulls are encoded as `-` in a leaf; a
    null lang is a tree of its own, the first one; null ids come first in a tree. Rows of one id are in the order of
    their leaves; repeated rows are leaves each. The only leaf of a tree is its subroot, and the only subroot
    is the root; the proof of a leaf without siblings is the digest of nothing. An empty table gives an empty result.
    """
    nodes = ranked(written(leaves(docs), "leaves"), ["doc_id", "leaf"], "ordered").withColumn("node", F.col("leaf"))
    nodes = written(nodes, "ranked")
    levels, subroots = _levels(nodes, ["doc_id", "leaf", "fake"])
    subroots = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("own"), "node", F.col("height").alias("rounds"))
    tops = written(ranked(subroots, ["own"], "tops"), "topranks")
    above, roots = _levels(tops, [])
    root = roots.select(F.col("node").alias("root"))  # one row, none for an empty table

    # from the root to the subroots
    segment = "array<struct<digit:int,others:array<string>>>"
    frontier = roots.select(F.lit(TOP).alias("tree"), F.lit(0).cast("long").alias("rank"), "node", F.expr(f"cast(array() as {segment})").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for records in reversed(above):
        frontier = _down(frontier, records)
    starts = frontier.join(tops.select("rank", "own", "rounds"), "rank").select(
        F.col("own").alias("tree"), F.lit(0).cast("long").alias("rank"), "node", "path", F.col("node").alias("subroot"), F.col("rounds").alias("height")
    )
    starts = written(starts, "starts")

    # from the subroots to the leaves: trees of one height enter together
    frontier = None
    for height in range(len(levels), 0, -1):
        enter = starts.filter(F.col("height") == height).drop("height")
        frontier = enter if frontier is None else frontier.unionByName(enter)
        frontier = _down(frontier, levels[height - 1], *(["requests"] if height == 1 else []))
        if height > 1:
            frontier = written(frontier, "frontier")
    alone = nodes.join(starts.filter("height = 0").select("tree", "path", "subroot"), "tree")
    reached = alone.select("doc_id", "leaf", "fake", "path", "subroot")
    if frontier is not None:
        reached = frontier.select("request.doc_id", "request.leaf", "request.fake", "path", "subroot").unionByName(reached)
    reached = reached.withColumn("path", F.reverse("path")).crossJoin(F.broadcast(root))
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: s["others"])), "")
    out = reached.select("doc_id", "leaf", "subroot", "root", "path", F.sha2(siblings, 256).alias("proof_sha256"), _fold(F.coalesce("fake", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
