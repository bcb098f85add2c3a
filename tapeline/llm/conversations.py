"""Repair of the structure of conversations by cheapest edits.

Every row of a conversation is kept, reroled or deleted, and empty rows may be inserted, so that the
roles read `(s?(ua)+)?` by their initials. Edit scripts are paths in a layered graph whose nodes are (rows
read, inserts made, state of that pattern). A path's weight is one integer: its high digits are the
cost; below them each edit's letter stands as the digit of its position, and positions that a script doesn't
reach are zero. The least integer is the cheapest script, and of equally cheap ones the ASCII-least;
its digits are the script, so nothing else is stored or compared.

Two scans, each with one shuffle by conversation. The first carries a code a row, never a text, and gives
the edits. The second merges each conversation's edits with its rows and streams the repaired rows; texts are
never gathered. What a task holds of one conversation is a byte a row, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What edits cost: Rerole, Delete, Insert, and a truncated row that is not deleted. Keep costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters of edits in ASCII order; a letter's digit is its place from 1, zero is the end.
LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
BITS = 3
#: Rows whose edits are written out in one integer; longer conversations go on from the ranks of the four states.
BLOCK = 1024
#: States: nothing yet, after s, after u, after a. What follows on an initial (0 is any other), and the role that may come next.
START, S, U, A = 0, 1, 2, 3
NEXT = ((None, S, U, None), (None, None, U, None), (None, None, None, A), (None, None, U, None))
WANTED = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}
SOUND, CUT, GONE = 0, 1, 2
NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"


# ---------------------------------------------------------------- least edits of one conversation


def most_inserts(codes: bytes) -> int:
    """The most inserts that any cheapest script makes: least of cost * base - inserts, state by state."""
    base = 2 * len(codes) + 8
    best = {START: 0}
    for code in (*codes, None):
        for a, b in ((START, U), (S, U), (A, U), (U, A)):
            if a in best:
                best[b] = min(best.get(b, best[a] + INSERT * base), best[a] + INSERT * base - 1)
        if code is None:
            break
        after: dict[int, int] = {}
        for state, weight in best.items():
            for _, cost, to in _consuming(code, state):
                after[to] = min(after.get(to, weight + cost * base), weight + cost * base)
        best = after
    return -min(best[s] for s in (START, A) if s in best) % base


def _consuming(code: int, state: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of a row: initial + 4 * fault."""
    fault, kept = code >> 2, NEXT[state][code & 3]
    edges = [(D, DELETE, state)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        edges.append((R, REROLE + more, WANTED[state]))
        if kept is not None:
            edges.append((K, more, kept))
    return edges


EDGES = [[_consuming(code, state) for state in range(4)] for code in range(12)]


def _least(codes: bytes, enter: dict[int, tuple[int, int]], inserts: int) -> list[dict[int, int]]:
    """Least weight of every (inserts made, state) after the rows. enter: cost and rank of each first state.

    Digits from the top: cost; the rank; then one letter a position, as many as rows and inserts.
    """
    width = BITS * (len(codes) + inserts)
    layers: list[dict[int, int]] = [{s: cost << (width + BITS) | rank << width for s, (cost, rank) in enter.items()}]
    layers += [{} for _ in range(inserts)]
    unit = 1 << (width + BITS)
    for i in range(len(codes) + 1):
        for j in range(inserts):
            weight = INSERT * unit + (I << (width - BITS * (i + j + 1)))
            for state, w in layers[j].items():
                to, low = WANTED[state], layers[j + 1]
                if to not in low or w + weight < low[to]:
                    low[to] = w + weight
        if i == len(codes):
            return layers
        for j in range(inserts + 1):
            after: dict[int, int] = {}
            shift = width - BITS * (i + j + 1)
            for state, w in layers[j].items():
                for letter, cost, to in EDGES[codes[i]][state]:
                    now = w + cost * unit + (letter << shift)
                    if to not in after or now < after[to]:
                        after[to] = now
            layers[j] = after
    return layers


def least_edits(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows coded as initial + 4 * fault."""
    inserts = most_inserts(codes)
    step = len(codes) + 1 if inserts else BLOCK
    enter, trails = {START: (0, 0)}, [(None, "")]
    for low in range(0, max(len(codes), 1), step):
        part = codes[low : low + step]
        width = BITS * (len(part) + inserts)
        least: dict[int, int] = {}
        for layer in _least(part, enter, inserts):
            for state, w in layer.items():
                least[state] = min(w, least.get(state, w))
        # digits below the cost, as they rank
        tails = sorted({w & ((1 << (width + BITS)) - 1) for w in least.values()})
        trails = [(trails[t >> width], _letters(t & ((1 << width) - 1), width)) for t in tails]
        enter = {s: (w >> (width + BITS), tails.index(w & ((1 << (width + BITS)) - 1))) for s, w in least.items()}
    cost, rank = min(enter[s] for s in (START, A) if s in enter)
    trail, parts = trails[rank], []
    while trail:
        parts.append(trail[1])
        trail = trail[0]
    return cost, "".join(reversed(parts))


def _letters(digits: int, width: int) -> str:
    octal = f"{digits:0{width // BITS}o}" if width else ""
    return octal.rstrip("0").translate({48 + k: LETTERS[k - 1] for k in (D, I, K, R)})


# ---------------------------------------------------------------- rows


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    [.!?], 3 repeats it, 4 sets its role to user. A null in any column is one space in the key, role and text."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_"),
    ).drop("_")


def _rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls, and the text's digest, which settles ties."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def _coded(rows: DataFrame) -> DataFrame:
    """A code for each row: its role's initial, and 4 * its first fault (blank 1, duplicate 2, truncated 3)."""
    first = F.min(F.struct("turn", "row")).alias("first")
    marked = rows.select(
        "conv_id", "turn", "role", "digest", (~F.col("text").rlike(NOT_BLANK)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"),
        F.monotonically_increasing_id().alias("row"),
    )
    # the number of a row only tells copies of one turn apart: whichever is first, results are the same
    marked = written(marked, "marked")
    seen = marked.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), first).filter("n > 1").select(
        F.struct(F.col("conv_id").isNull().alias("k"), F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).alias("key"), "first"
    )
    key = F.struct(F.col("conv_id").isNull().alias("k"), F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    marked = marked.withColumn("key", key).join(seen, "key", "left")
    later = F.col("first").isNotNull() & (F.struct("turn", "row") != F.col("first"))
    fault = F.when(F.col("blank"), 1).when(F.coalesce(later, F.lit(False)), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(0)
    return marked.select("conv_id", "turn", "role", "digest", "row", (initial + 4 * fault).cast("int").alias("code"))


def _together(rows: DataFrame, *order: str) -> DataFrame:
    """Conversations whole in one partition, in order; nulls come first."""
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *order)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary row for each conversation of a sorted stream of codes."""
    done: list[tuple] = []
    now, codes, turns = None, bytearray(), [0, 0, 0]

    def close() -> None:
        faults = [c >> 2 for c in codes]
        initials = [c & 3 for c in codes]
        illegal = sum((x, y) not in ((S, U), (U, A), (A, U)) for x, y in zip(initials, initials[1:]))
        plan = bytes((c & 3) + 4 * (GONE if c >> 2 in (1, 2) else CUT if c >> 2 == 3 else SOUND) for c in codes)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        done.append((now[0], gaps, faults.count(1), faults.count(2), faults.count(3), illegal, *least_edits(plan)))

    for batch in batches:
        for conv, turn, code in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now, codes, turns = (conv,), bytearray(), [0, 0, 0]
            codes.append(code)
            if turn is not None and not (turns[2] and turns[1] == turn):
                turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
        if len(done) >= 1000:
            yield _batch(done, SUMMARY)
            done = []
    if now is not None:
        close()
    if done:
        yield _batch(done, SUMMARY)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.strip().split(" ") for c in schema.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), names)], names=[n for n, _ in names])


def summaries(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal pairs, and the cost and letters of its cheapest edits.

    rows: conv_id, turn, role, text; other columns are ignored. A null conv_id is a conversation; rows of a null
    turn come first; a null role or text is one space. Rows of one turn are ordered by role, then by
    the digest of the text, so repeated rows stand side by side and all but the first are duplicates.
    Roles count by their initials, so `User` is neither. An empty table gives none.
    """
    ordered = _together(_coded(_rows(rows)), "turn", "role", "digest", "row").select("conv_id", "turn", "code")
    return ordered.mapInArrow(_solve, SUMMARY)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from a stream in which each conversation's letters come before its rows."""
    audit, at, state, position = "", 0, START, 0
    out: list[tuple] = []

    def emit(conv: int | None, letter: str, role: str, text: str) -> None:
        nonlocal position, at
        out.append((conv, position, letter, role, text))
        position, at = position + 1, at + 1

    def insert(conv: int | None) -> None:
        nonlocal state
        while at < len(audit) and audit[at] == "I":
            state = WANTED[state]
            emit(conv, "I", ROLES[state], "")

    for batch in batches:
        size = 0
        for conv, role, text, letters in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if letters is not None:
                audit, at, state, position = letters, 0, START, 0
                insert(conv)
                continue
            if audit[at] == "D":
                at += 1
            elif audit[at] == "K":
                state = NEXT[state][{"s": S, "u": U, "a": A}[role[0]]]
                emit(conv, "K", role, text)
            else:
                state = WANTED[state]
                emit(conv, "R", ROLES[state], text)
            insert(conv)
            size += len(text)
            if size > 1 << 23:
                yield _batch(out, REPAIRED)
                out, size = [], 0
        if out:
            yield _batch(out, REPAIRED)
            out = []


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position, edit, role, text; each conversation in order in one partition.

    found: summaries of the same rows, written. Nulls, ties and repeated rows as there; deleted rows are left out.
    """
    letters = found.select("conv_id", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("audit").alias("letters"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"))
    own = _rows(rows).select("conv_id", "role", "text", F.lit(None).cast("string").alias("letters"), "turn", "digest", F.lit(1).alias("kind"))
    stream = _together(letters.unionByName(own), "kind", "turn", "role", "digest")
    return stream.select("conv_id", "role", "text", "letters").mapInArrow(_apply, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, running, done = None, hashlib.sha256(), []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if now is not None and now[0] == conv:
                running.update(b"\n")
            else:
                if now is not None:
                    done.append((now[0], running.hexdigest()))
                now, running = (conv,), hashlib.sha256()
            running.update(f"{role}:{text}".encode())
        if len(done) >= 1000:
            yield _batch(done, "conv_id long, repaired_sha256 string")
            done = []
    if now is not None:
        done.append((now[0], running.hexdigest()))
        yield _batch(done, "conv_id long, repaired_sha256 string")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """sha256 of each conversation's repaired `role:text` lines, from the rows as repaired() streams them."""
    return repaired_rows.select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Summary and digest of every conversation of a table, also of those that have no row in `rows`: zeros,
    an empty audit and the digest of nothing."""
    found = written(summaries(rows), "edits")
    lines = digests(repaired(rows, found))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))

    every = keyed(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    joined = every.join(keyed(found).drop("conv_id"), "key", "left").join(keyed(lines).drop("conv_id"), "key", "left")

    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0).cast("long")).alias(name)

    return joined.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
