"""Matches of patterns with their positions, with DataFrame functions only.

A span is struct<s:int, e:int, m:string>: start and end (exclusive) in code points, and the match.
Patterns repeat groups only possessively, which Java's matcher does in a loop: long runs need no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPANS = "array<struct<s:int,e:int,m:string>>"
MARKS = "array<struct<s:int,k:int,e:int>>"
#: Matches whose positions are summed up at once; see positions().
BLOCK = 64


def none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def _sums(steps: Column) -> Column:
    """Running sums before each of up to BLOCK steps."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(steps, zero, add)["out"]


def positions(steps: Column) -> Column:
    """Running sums before each step. Blocks are summed first, then each block from its start: a
    list is copied only within a block and among blocks."""

    def of(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(x, i, BLOCK))
        total = lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)

        def joined(b: Column) -> Column:
            upto = F.transform(b, total)
            return let(_sums(upto), lambda base: F.flatten(
                F.transform(b, lambda block, j: F.transform(_sums(block), lambda v: v + F.get(base, j)))
            ))

        return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))

    return let(steps, of)


def matches(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches of a pattern (never of the empty string)."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(gaps: Column, hits: Column) -> Column:
        steps = F.transform(hits, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        start = lambda at, i: at + F.length(F.get(gaps, i))
        return F.transform(positions(steps), lambda at, i: F.struct(
            start(at, i).alias("s"), (start(at, i) + F.length(F.get(hits, i))).alias("e"), F.get(hits, i).alias("m")
        ))

    found = let(F.split(text, regex, -1), lambda gaps: let(F.regexp_extract_all(text, regex, F.lit(0)), lambda hits: placed(gaps, hits)))
    return F.when(F.rlike(text, regex), found.cast(SPANS)).otherwise(none())


def marked(spans: Column, kind: int) -> Column:
    """Spans as (start, rank of the kind, end), the order in which they are listed."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def listed(marks: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of marks by start, then kind, comma-joined."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(F.sort_array(marks), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def outside(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
