"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its words (runs without white space, A-Z lowered). Two lines match if their
Jaccard similarity is 0.8 or more; a line goes if an earlier line (by doc_id, then line number)
matches it, whether or not that one goes too.

Words are ordered by rarity: by the counts of a sketch of BUCKETS counters over the whole corpus,
then by hash. Any fixed order makes the filters exact; rare words first make them sharp. Lines
with one set are a class, known by its first occurrence. Two classes can match only if they share a
word among the first n - ceil(0.8 n) + 1 words of both (prefix), their sizes are within 0.8
(length), the words left after the shared one suffice (positional), and the parities of their words'
hashes over 64, 128 or 256 places differ in no more places than the sets may (an exact bound on the
difference).

Every prefix word of every class is shuffled once. All pairs of classes that pass the filters are
verified, each exactly once, and never become rows:

- Pairs of lines of up to SHORT words meet again, with their words, where their first shared word
  meets.
- Pairs with a longer line are joined to components first, and each line's words are sent to its
  component once. Components above WORDS words are cut into parts, and every two parts meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, discard, int64s, mix, prefix_hash, slices, span_hashes, spaced, text_bytes, word_bounds, written
from .components import components, forest

BUCKETS, CHUNK = 1 << 21, 1 << 20
#: Classes that meet at a word in one task; more are cut into parts, and every two parts meet.
PART = 1 << 15
#: Words of lines that are sent with their keys to each prefix word; longer ones go to components.
SHORT = 24
#: Words of a component that one task takes, of each of two parts.
WORDS = 1 << 19
#: Words of lines whose parities are over 64 and over 128 places; longer ones have 256.
NARROW, WIDE = 64, 192
#: Bits of the filter that tells which lines' words are wanted; 16 MB at any size of the corpus.
FILTER = 1 << 27
#: Pairs held before they are handed on, and compared at once.
PAIRS, VERIFY = 1 << 20, 1 << 15
LINES = "k1 long, k2 long, doc_id long, text_key long, line int, n int, prefix binary, flagged int, p2 long, p3 long, p4 long"
#: Numbers of one row when counters are summed.
BLOCK = 1 << 15


def words(data: np.ndarray, at: np.ndarray, low: int, high: int):
    """Hash and line of each word of some texts, and document and number of each line."""
    buffer, ends, doc, number = line_ends(data, at, low, high)
    start, end = word_bounds(buffer, NOT_SPACE)
    hashes = span_hashes(prefix_hash(LOWER[buffer]), start, end)
    return hashes, np.searchsorted(ends, start), doc, number


def line_ends(data: np.ndarray, at: np.ndarray, low: int, high: int):
    """The texts' bytes with a space after each, and the end, document and number of each line."""
    buffer, rows = spaced(data, at, low, high)
    ends = np.sort(np.concatenate((np.flatnonzero(buffer == 10), rows[1:] - 1)))
    doc = np.searchsorted(rows, ends, "right") - 1
    return buffer, ends, doc, np.arange(len(ends)) - np.searchsorted(ends, rows[doc])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held = np.zeros(BUCKETS, np.int64), [np.zeros(0, np.int64)]

    def add() -> None:
        total[:] += np.bincount(np.concatenate(held), minlength=BUCKETS)

    for batch in batches:
        data, at = text_bytes(batch)
        for low, high in slices(at, CHUNK):
            hashes = words(data, at, low, high)[0]
            held.append((hashes >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int64))
            if sum(map(len, held)) >= BUCKETS:
                add()
                held = [np.zeros(0, np.int64)]
    add()
    for k in np.flatnonzero(total.reshape(-1, BLOCK).any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * BLOCK : (k + 1) * BLOCK].tobytes()])], ["block", "counts"])


def _logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of each block (at most BUCKETS in all) and takes their logarithms."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(counts, np.int64)
    logs = [(np.log2(1.0 + x) * 1024).astype(np.uint16).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], ["block", "logs"])


def rarity(docs: DataFrame) -> np.ndarray:
    """For each of BUCKETS hashes, 1024 times the binary logarithm of 1 + the count of its words over
    all documents."""
    counts = docs.select("text").mapInArrow(_count, "block int, counts binary")
    table = counts.repartition("block").mapInArrow(_logs, "block int, logs binary").toArrow()  # 2 * BUCKETS bytes
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint16)
    for k, logs in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        out[k] = np.frombuffer(logs, np.uint16)
    return out.ravel()


def least(n: np.ndarray) -> np.ndarray:
    """Words that two sets of n words in all must share for a Jaccard of 0.8."""
    return -(-4 * n // 9)


def keys_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words as numbers in order of rarity: 16 bits of the logarithm of the count, 48 of the hash."""
    code = counts[(hashes >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int64)]
    return (code.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))


def sets(hashes: np.ndarray, line: np.ndarray, counts: np.ndarray):
    """Distinct keys of the lines with words, in order: keys, where each line begins, the lines."""
    keys = keys_of(hashes, counts)
    # one sort by line and the first bits of the key; where those tie for two keys, by all of it
    bits = np.uint64(max(1, int(line[-1]).bit_length()) if len(line) else 1)
    short = (line.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits)
    order = np.argsort(short)
    tied = short[order][1:] == short[order][:-1]
    if (keys[order][1:] != keys[order][:-1])[tied].any():
        order = np.lexsort((keys, line))
    keys, line = keys[order], line[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    keys, line = keys[new], line[new]
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    return keys, begin, line[begin]


def level(n: np.ndarray) -> np.ndarray:
    """0, 1 or 2 as the parities of a line of n words have 64, 128 or 256 places."""
    return (n > NARROW).astype(np.int64) + (n > WIDE)


def marks(keys: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each line: parities of its keys over 64 places, a sum of their mixed hashes, and the
    second to fourth words of the wider parities (0 where the line has none)."""
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, [none] * 3
    n = np.diff(np.append(begin, len(keys)))
    bit = np.uint64(1) << (keys & np.uint64(63))
    more, wide = [np.zeros(len(n), np.int64) for _ in range(3)], np.flatnonzero(level(n))
    if len(wide):
        inside, sizes = np.repeat(level(n) > 0, n), n[wide]
        word = (keys[inside] >> np.uint64(6)).astype(np.int64) & np.repeat(np.array([0, 1, 3])[level(sizes)], sizes)
        for k in (1, 2, 3):
            own = np.where(word == k, bit[inside], np.uint64(0))
            more[k - 1][wide] = np.bitwise_xor.reduceat(own, np.cumsum(sizes) - sizes).view(np.int64)
    return np.bitwise_xor.reduceat(bit, begin).view(np.int64), np.add.reduceat(mix(keys), begin).view(np.int64), more


def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the bytes of values, cut at ends (from 0)."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _lines(shared, part: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            data, at = text_bytes(batch)
            ids, texts = int64s(batch, "doc_id"), int64s(batch, "text_key")
            for low, high in slices(at, CHUNK):
                hashes, line, doc, number = words(data, at, low, high)
                keys, begin, own = sets(hashes, line, counts)
                k1, k2, more = marks(keys, begin)
                n = np.diff(np.append(begin, len(keys)))
                size = n + (-4 * n // 5) + 1  # n - ceil(0.8 n) + 1
                place = np.arange(len(keys)) - np.repeat(begin, n)
                first = place < np.repeat(size, n)
                token = (mix(keys[first]) >> np.uint64(33)).astype(np.int32)
                hot = counts[(keys[first] & np.uint64(BUCKETS - 1)).astype(np.int64)] > np.log2(part) * 1024
                token = np.where(hot, -1 - token, token)  # below 0: may be shared by very many lines
                ends = np.concatenate(([0], np.cumsum(size)))
                flagged = np.add.reduceat(hot, ends[:-1], dtype=np.int32) if len(n) else size.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1), pa.array(k2), *[x.take(pa.array(doc[own] + low)) for x in (ids, texts)], pa.array(number[own].astype(np.int32)),
                        pa.array(n.astype(np.int32)), binary(token, ends), pa.array(flagged), *[pa.array(p) for p in more],
                    ],
                    ["k1", "k2", "doc_id", "text_key", "line", "n", "prefix", "flagged", "p2", "p3", "p4"],
                )

    return lines


def _one(t: pa.Table, k: int) -> pa.Array:
    column = t.column(k)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


class Entries:
    """Rows of ENTRY_SCHEMA, sorted by key: the word's (or part's) number, and the size of the set."""

    def __init__(self, t: pa.Table):
        key, self.own, self.id, place, k1, p2, p3, p4 = (c.to_numpy() for c in t.columns[:8])
        self.key, self.n, self.place = key >> 32, key & 0xFFFFFFFF, place.astype(np.int64)
        self.parity, self.level = np.stack((k1 ^ p2 ^ p3 ^ p4, p2, p3, p4)).view(np.uint64), level(self.n)

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether classes i and j may match, and the words at their places be the first that they share.

        Rows below 0 in own meet all others; else rows of different parts meet. The words before the
        first shared one are in one set only, so they count as differences."""
        n, place = self.n, self.place
        both = n[i] + n[j]
        need = least(both)
        apart = both - 2 * need
        left = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = ((self.own[i] < 0) | (self.own[i] != self.own[j])) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        ok &= (left >= need) & (place[i] + place[j] <= apart)
        some = np.flatnonzero(ok)
        i, j, apart = i[some], j[some], apart[some]
        d = self.parity[:, i] ^ self.parity[:, j]
        # the wider parities of one side are folded to the places of the other
        places = np.minimum(self.level[i], self.level[j])
        count = np.bitwise_count(d[0] ^ d[1] ^ d[2] ^ d[3]).astype(np.int64)
        middle = np.bitwise_count(d[0] ^ d[2]).astype(np.int64) + np.bitwise_count(d[1] ^ d[3])
        whole = sum(np.bitwise_count(x).astype(np.int64) for x in d)
        ok[some] = np.where(places == 2, whole, np.where(places == 1, middle, count)) <= apart
        return ok


def _reach(key, n) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key and n: from where to where (exclusive) the rows of its key are within 0.8."""
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(np.int64) << 32
    return np.searchsorted(group + n, group - (-4 * n // 5)), np.searchsorted(group + n, group + 5 * n // 4, "right")


def _flags(e: Entries) -> np.ndarray:
    """Whether each row has another of its key that it may match. Every step is a few numpy calls
    for all rows that still have none: they meet their next neighbour on either side."""
    low, high = _reach(e.key, e.n)
    some = np.zeros(len(e.key), bool)
    x = np.arange(len(e.key))
    step = 1
    while len(x):
        for y in (x + step, x - step):
            inside = (y >= low[x]) & (y < high[x])
            i, j = x[inside], y[inside]
            ok = e.fits(i, j)
            some[i[ok]] = some[j[ok]] = True
        step += 1
        x = x[~some[x] & ((x + step < high[x]) | (x - step >= low[x]))]
    return some


def _joined(e: Entries, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) that join what the pairs with a line above `short` words join that may match.
    Rows of one component meet no more, and a key that is one component is left alone."""
    _, high = _reach(e.key, e.n)
    label, x, step = np.arange(len(e.key)), np.arange(len(e.key)), 1
    begin = np.flatnonzero(np.concatenate(([True], e.key[1:] != e.key[:-1])))
    rows = np.diff(np.append(begin, len(e.key)))
    while len(x := x[x + step < high[x]]):
        y = x + step
        go = (label[x] != label[y]) & (e.n[y] > short)  # y is the longer
        i, j = x[go], y[go]
        ok = e.fits(i, j)
        if ok.any():
            node, root = forest(label[i[ok]], label[j[ok]])
            to = np.arange(len(label))
            to[node] = root
            label = to[label]
        if step & (step - 1) == 0:
            one = np.minimum.reduceat(label, begin) == np.maximum.reduceat(label, begin)
            x = x[~np.repeat(one, rows)[x]]
        step += 1
    away = label != np.arange(len(label))
    return forest(e.id[away], e.id[label[away]])


def _pairs(most: int, e: Entries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one key that may match, some at a time."""
    _, high = _reach(e.key, e.n)
    x, step, held, rows = np.arange(len(e.key)), 1, [], 0
    while len(x := x[x + step < high[x]]):
        ok = x[e.fits(x, x + step)]
        held.append((ok, ok + step))
        rows += len(ok)
        if rows > most:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, rows = [], 0
        step += 1
    if rows:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _by_key(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables of about `most` rows that cut no word's or part's
    number (its upper half)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(0).to_numpy() >> 32
        done = int(np.searchsorted(key, key[-1]))
        if done:
            yield t.slice(0, done).combine_chunks()
        held, rows = t.slice(done).to_batches(), len(key) - done
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _met(short: int):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of short lines with a possible partner, and links (id, other) of longer ones."""
        for t in _by_key(batches, 1 << 18):
            n = t.column(0).to_numpy() & 0xFFFFFFFF
            few = t.filter(pa.array(n <= short)).combine_chunks()
            few = few.filter(pa.array(_flags(Entries(few)))).combine_chunks() if few.num_rows else few
            yield pa.RecordBatch.from_arrays([*[_one(few, k) for k in range(8)], pa.nulls(few.num_rows, pa.int64())], [*ENTRY_NAMES, "other"])
            more = t.filter(pa.array(5 * n > 4 * short))
            if more.num_rows:
                a, b = _joined(Entries(more.combine_chunks()), short)
                zero = pa.array(np.zeros(len(a), np.int64))
                half = zero.cast(pa.int32())
                yield pa.RecordBatch.from_arrays([zero, half, pa.array(a), half, *[zero] * 4, pa.array(b)], [*ENTRY_NAMES, "other"])

    return met


ENTRY_NAMES = ["key", "own", "id", "place", "k1", "p2", "p3", "p4"]
ENTRY_SCHEMA = "key long, own int, id long, place int, k1 long, p2 long, p3 long, p4 long"


def keyed(meet, n):
    """The upper half of a number for where rows meet, and the size of the set."""
    return F.shiftleft(meet, 32).bitwiseOR(F.col(n).cast("long"))


def in_parts(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows with `key` and `own` for a key in `parts`: every two parts meet once, and each meets itself."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    one = lambda meet, own: F.struct(meet.alias("meet"), own.cast("int").alias("own"))
    meet = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: one(F.xxhash64(key, F.least(part, k), F.greatest(part, k)), F.when(k == part, -1).otherwise(part)),
    )
    return rows.select("*", F.explode(meet).alias("m")).withColumn("key", keyed(F.col("m.meet"), size)).withColumn("own", F.col("m.own"))


def _entries(flagged: bool):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each prefix word of classes (id, n, prefix, k1, p2, p3, p4): those that may be hot, or the others."""
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(low, 1 << 12)
                n = part.column(1).to_numpy().astype(np.int64)
                size = n + (-4 * n // 5) + 1
                token = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int32).astype(np.int64)
                row = np.repeat(np.arange(len(n)), size)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                keep = np.flatnonzero((token < 0) == flagged)
                row, token, place = row[keep], token[keep], place[keep]
                key = pa.array((token << 32) | n[row])
                own, rows = pa.array(np.full(len(row), -1, np.int32)), pa.array(row)
                others = [part.column(k).take(rows) for k in (0, 3, 4, 5, 6)]
                yield pa.RecordBatch.from_arrays([key, own, others[0], pa.array(place.astype(np.int32)), *others[1:]], ENTRY_NAMES)

    return entries


def flagged_entries(classes: DataFrame) -> DataFrame:
    rows = classes.filter("flagged > 0").select("id", "n", "prefix", "k1", "p2", "p3", "p4").mapInArrow(_entries(True), ENTRY_SCHEMA)
    return rows.withColumn("token", F.shiftright("key", 32))


def entries_of(classes: DataFrame, hot: DataFrame) -> DataFrame:
    """ENTRY_SCHEMA of each prefix word of each class, dealt and sorted by key."""
    plain = classes.select("id", "n", "prefix", "k1", "p2", "p3", "p4").mapInArrow(_entries(False), ENTRY_SCHEMA)
    some = flagged_entries(classes).join(hot, "token", "left").withColumn("n", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    cut = in_parts(some.filter("parts IS NOT NULL"), "token", "n")
    every = plain.unionByName(some.filter("parts IS NULL").select(*ENTRY_NAMES)).unionByName(cut.select(*ENTRY_NAMES))
    return every.repartition(F.shiftright("key", 32)).sortWithinPartitions("key")


def _place(doc: pa.Array, line: np.ndarray) -> np.ndarray:
    """The bit of FILTER for lines of documents."""
    ids = doc.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    return (mix(mix(ids) + line.astype(np.uint64)) & np.uint64(FILTER - 1)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.unique(_place(batch.column(0), batch.column(1).to_numpy()))
        word, start = np.unique(bit >> 6, return_index=True)
        masks = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(masks.view(np.int64))], ["word", "bits"])


def line_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of FILTER bits with those of all wanted lines (doc_id, line) set."""
    table = wanted.select("doc_id", "line").mapInArrow(_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)  # the table has at most as many rows
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def _fetch(shared, wanted):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k1, k2, keys of the lines that pass the filter; no others are cut into words."""
        counts, bits = shared.value, wanted.value
        for batch in batches:
            data, at = text_bytes(batch)
            ids = int64s(batch, "doc_id")
            for low, high in slices(at, CHUNK):
                text, end, doc, number = line_ends(data, at, low, high)
                start = np.concatenate(([0], end[:-1] + 1))
                place = _place(ids.take(pa.array(doc + low)), number)
                some = np.flatnonzero(bits[place >> 6] >> (place & 63) & 1)
                raw = [text[i:j] for i, j in zip(start[some].tolist(), end[some].tolist())]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
                keys, begin, _ = sets(*words(np.concatenate([np.zeros(0, np.uint8), *raw]), offsets, 0, len(raw))[:2], counts)
                k1, k2, _ = marks(keys, begin)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), binary(keys, np.append(begin, len(keys)))], ["k1", "k2", "keys"])

    return fetch


def keys_for(wanted: DataFrame, classes: DataFrame, rows: DataFrame, shared) -> DataFrame:
    """id, n, doc_id, line, keys of the classes in wanted (id). The texts are read once more and never
    moved: a bitmap of bounded size tells where the wanted lines are, and by its marks a line is known
    as of its class, also where documents share an id."""
    ones = written(classes.select("id", "k1", "k2", "n", "doc_id", "line").join(wanted.distinct(), "id"), "classes-wanted")
    bits = rows.sparkSession.sparkContext.broadcast(line_filter(ones))
    keys = rows.mapInArrow(_fetch(shared, bits), "k1 long, k2 long, keys binary")
    found = written(ones.join(keys, ["k1", "k2"]).select("id", "n", "doc_id", "line", "keys").dropDuplicates(["id"]), "line-keys")
    bits.unpersist()
    discard(ones)
    return found


class _Sets:
    """The key sets of some rows, for exact comparisons of many pairs at once."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.n = np.array([len(r) // 8 for r in raw], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        names, rank = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        self.rank, self.size = rank.astype(np.int64), len(names)
        self.code = np.repeat(np.arange(len(raw)), self.n) * self.size + self.rank

    def shared(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many keys each two rows share, and where in either the first of them is."""
        n = self.n[x]
        pair = np.repeat(np.arange(len(x)), n)
        in_x = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        want = y[pair] * self.size + self.rank[self.at[x][pair] + in_x]
        hit = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        f = np.flatnonzero(self.code[hit] == want)
        count = np.bincount(pair[f], minlength=len(x))
        first = np.minimum(np.cumsum(count) - count, max(len(f) - 1, 0))
        if not len(f):
            return count, first - 1, first - 1
        return count, in_x[f[first]], hit[f[first]] - self.at[y]

    def match(self, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return 9 * shared >= 4 * (self.n[x] + self.n[y])


class _Links:
    """Numbers of links of some rows (id, doc_id, line), and the earliest row linked to each."""

    def __init__(self, id_: pa.Array, doc: pa.Array, line: pa.Array):
        self.id, self.doc, self.line = id_, doc, line
        keys = (line.to_numpy(), doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False))
        self.order = np.lexsort(keys)
        differs = np.zeros(max(len(doc) - 1, 0), bool)
        for k in keys:
            differs |= k[self.order][1:] != k[self.order][:-1]
        self.rank = np.empty(len(doc), np.int64)
        self.starts = np.concatenate(([0], np.flatnonzero(differs) + 1))
        self.rank[self.order] = np.cumsum(np.concatenate(([0], differs)))
        self.links = np.zeros(len(doc), np.int64)
        self.best = np.full(len(doc), len(doc), np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in ((x, y), (y, x)):
            self.links += np.bincount(a, minlength=len(self.links))
            before = self.rank[b] < self.rank[a]
            np.minimum.at(self.best, a[before], self.rank[b[before]])

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        known = self.best[some] < len(self.best)
        one = self.order[self.starts[np.where(known, self.best[some], 0)]]
        line = np.where(known, self.line.to_numpy()[one], -1).astype(np.int32)
        return pa.RecordBatch.from_arrays([self.id.take(pa.array(some)), pa.array(self.links[some]), self.doc.take(pa.array(one)), pa.array(line)], LINK_NAMES)


LINK_NAMES = ["id", "links", "first_doc", "first_line"]
LINK_SCHEMA = "id long, links long, first_doc long, first_line int"  # first_line: -1 if no link is earlier


def _short_links(most: int, step: int):
    def short_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ENTRY_SCHEMA with doc_id, line, keys, sorted by key. A pair counts only where its first
        shared word meets, so that it counts once."""
        for t in _by_key(batches, 1 << 16):
            e, keys = Entries(t), _Sets(_one(t, 10))
            out = _Links(*(_one(t, k) for k in (2, 8, 9)))
            for x, y in _pairs(most, e):
                for i in range(0, len(x), step):
                    a, b = x[i : i + step], y[i : i + step]
                    shared, in_a, in_b = keys.shared(a, b)
                    ok = keys.match(a, b, shared) & (in_a == e.place[a]) & (in_b == e.place[b])
                    out.add(a[ok], b[ok])
            yield out.rows()

    return short_links


def _long_links(short: int, most: int):
    def long_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, own, id, doc_id, line, keys) sorted by key. Each row's words are marked in a bitmap
        of all, in which those of all later rows of the key within 0.8 are looked up."""
        for t in _by_key(batches, 1 << 13):
            key, own = (t.column(k).to_numpy() for k in range(2))
            n, key = key & 0xFFFFFFFF, key >> 32
            sets_, out = _Sets(_one(t, 5)), _Links(*(_one(t, k) for k in (2, 3, 4)))
            _, high = _reach(key, n)
            mark = np.zeros(sets_.size, np.uint8)
            held: list[tuple] = []
            rows = 0
            for x in np.flatnonzero(high > np.arange(len(n)) + 1).tolist():
                low, end = x + 1, int(high[x])
                mine = sets_.rank[sets_.at[x] : sets_.at[x + 1]]
                mark[mine] = 1
                shared = np.add.reduceat(mark[sets_.rank[sets_.at[low] : sets_.at[end]]], sets_.at[low:end] - sets_.at[low], dtype=np.int64)
                mark[mine] = 0
                ok = (9 * shared >= 4 * (n[x] + n[low:end])) & (n[low:end] > short)
                if own[x] >= 0:
                    ok &= own[low:end] != own[x]
                y = np.flatnonzero(ok) + low
                held.append((np.full(len(y), x), y))
                rows += len(y)
                if rows > most:
                    out.add(*(np.concatenate(c) for c in zip(*held)))
                    held, rows = [], 0
            if rows:
                out.add(*(np.concatenate(c) for c in zip(*held)))
            yield out.rows()

    return long_links


def links_of(classes: DataFrame, hot: DataFrame, rows: DataFrame, shared) -> DataFrame:
    """id, links, match: for each class with links to others, their number and the first occurrence
    (doc_id, line) of the earliest one before it, null if there is none."""
    met = written(entries_of(classes, hot).mapInArrow(_met(SHORT), f"{ENTRY_SCHEMA}, other long"), "met")
    active = met.filter("other IS NULL").drop("other")
    stars = components(met.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    roots = stars.select(F.col("node").alias("id"), "root").unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
    roots = written(roots, "roots")
    keys = keys_for(active.select("id").unionByName(roots.select("id")), classes, rows, shared)
    few = active.join(keys.drop("n"), "id").select(*ENTRY_NAMES, "doc_id", "line", "keys")
    few = few.repartition(F.shiftright("key", 32)).sortWithinPartitions("key").mapInArrow(_short_links(PAIRS, VERIFY), LINK_SCHEMA)
    more = parts = written(roots.join(keys, "id"), "component-keys")
    large = more.groupBy("root").agg(F.sum("n").alias("all")).filter(F.col("all") > WORDS)
    large = written(large.select("root", F.ceil(F.col("all") / WORDS).cast("int").alias("parts")), "large")
    more = more.join(large, "root", "left")
    columns = ("key", "own", "id", "doc_id", "line", "keys")
    whole = more.filter("parts IS NULL").withColumn("key", keyed(F.xxhash64("root"), "n")).withColumn("own", F.lit(-1)).select(*columns)
    more = whole.unionByName(in_parts(more.filter("parts IS NOT NULL"), "root", "n").select(*columns))
    more = more.repartition(F.shiftright("key", 32)).sortWithinPartitions("key").mapInArrow(_long_links(SHORT, PAIRS), LINK_SCHEMA)
    first = F.when(F.col("first_line") >= 0, F.struct(F.col("first_doc").alias("doc_id"), F.col("first_line").alias("line")))
    found = few.unionByName(more).groupBy("id").agg(F.sum("links").alias("links"), F.min(first).alias("match"))
    found = written(found, "links")
    discard(met, roots, keys, parts, large)
    return found


def text_key() -> Column:
    """A hash of the text; a null one is as an empty one, which has no words either."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def linked_lines(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, text_key, line, class_doc, class_line, members, links, match: every line of a class that has
    more members or links, with its class's first occurrence, its members, and its links. A row of docs is known by
    its id and a hash of its text, since ids may repeat."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(rarity(rows))
    lines = written(rows.mapInArrow(_lines(shared, PART), LINES), "lines")
    # all that a set says is the same in all of its lines: as keys they need no sort, nor does the
    # least (doc_id, line) as one number; a null doc_id is before all others
    lit = lambda n: F.lit(Decimal(n))
    at = (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), lit(-(1 << 63) - 1)) * lit(1 << 32) + F.col("line")).cast("decimal(38,0)")
    classes = lines.groupBy("k1", "k2", "n", "prefix", "flagged", "p2", "p3", "p4").agg(F.min(at).alias("at"), F.count("*").alias("members"))
    number = F.pmod("at", lit(1 << 32))
    first = F.when(F.col("at") >= lit(-(1 << 95)), ((F.col("at") - number) / lit(1 << 32)).cast("long"))
    # written at once, so that a class keeps its number
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", first.alias("doc_id"), number.cast("int").alias("line"), "n", "prefix", "flagged", "members", "p2", "p3", "p4"), "classes")
    hot = flagged_entries(classes).groupBy("token").count().filter(F.col("count") > PART)
    hot = written(hot.select("token", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "hot-words")
    links = links_of(classes, hot, rows, shared)
    known = classes.select("id", "k1", "k2", F.col("doc_id").alias("class_doc"), F.col("line").alias("class_line"), "members").join(links, "id", "left")
    known = known.filter("members > 1 OR links IS NOT NULL").withColumn("links", F.coalesce("links", F.lit(0))).drop("id")
    known = written(known, "known")
    discard(classes, hot, links)
    return lines.select("k1", "k2", "doc_id", "text_key", "line").join(known, ["k1", "k2"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed: (line, doc_id of the earliest match) by line, from 0; linked:
    (line, class_id, class_doc, class_line, links) of each line whose class has other lines or links; text_key, which
    tells rows of one id apart.

    Lines with one set of words have one class_id, known by its first occurrence (class_doc,
    class_line); links: how many other classes match it, before or after. Lines not in linked are
    classes of their own without links.

    docs: doc_id, text; other columns are ignored. A null text has no lines, an empty one has one.
    Lines without words stay. A null doc_id is before all others. Rows of one id and different texts have their own lines
    removed; where both have the same line at the same place, neither is the earlier one. Repeated rows are one document:
    each has a row, and its lines are no earlier lines of the other. An empty table gives none.
    """
    first = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line") == F.col("class_line"))
    # a later member's earliest match may be the class itself or a class that it is linked to
    own = F.struct(F.col("class_doc").alias("doc_id"), F.col("class_line").alias("line"))
    match = F.when(first, F.col("match")).otherwise(F.least(own, F.coalesce("match", own)))
    gone = F.when(match.isNotNull(), F.struct("line", match["doc_id"].alias("doc_id")))
    link = F.struct("line", F.lower(F.format_string("%016x%016x", "k1", "k2")).alias("class_id"), "class_doc", "class_line", "links")
    found = linked_lines(docs).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), gone.alias("gone"), link.alias("link"))
    found = found.groupBy("d", "t").agg(F.sort_array(F.collect_set("gone")).alias("removed"), F.sort_array(F.collect_set("link")).alias("linked"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed", "linked", "text_key")


def remove_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text without the lines that dedup_lines removed (found).

    Each row of docs is rewritten by its own lines, whatever ids it shares; repeated rows alike. A null text stays
    null, an empty one empty; a text that loses all of its lines is empty. An empty table gives none.
    """
    gone = found.filter("n_removed > 0").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.transform("removed", lambda x: x["line"]).alias("gone")).dropDuplicates(["d", "t"])
    rows = docs.select("doc_id", "text", text_key()).join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
