"""SimHash near-duplicates through a covering code.

A fingerprint is cut into two halves of 32 bits: two fingerprints with at most 4 differing bits
have a half with at most 2. In each half, 31 bits are covered by the perfect Hamming code of length
31: every word lies within the covering radius 1 of one codeword, its anchor. Two words at distance
2 have a word between them at distance 1 from both, so they are both within 1 + 1 of that word's
anchor: each fingerprint is replicated to every anchor within the covering radius plus the half's
threshold shared by the two sides (1 + 2/2), 15.5 anchors a half on average, and fingerprints are
compared at the anchors only. No pair within the threshold is missed, and every pair is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int64s, text_bytes, written
from .components import components, forest

SHINGLE, SEED, THRESHOLD, LENGTH = 4, 42, 4, 31


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of the 4-word shingles; 0 if there are no words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = len(words) - SHINGLE + 1
    for low in range(0, n, 1 << 16):
        cut = zip(starts[low : min(n, low + (1 << 16))].tolist(), ends[low + SHINGLE - 1 : low + SHINGLE - 1 + (1 << 16)].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in cut], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch)
        view = memoryview(data)
        marks = [fingerprint(bytes(view[at[i] : at[i + 1]])) for i in range(batch.num_rows)]
        fp = pa.array(np.array(marks, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([int64s(batch, "doc_id"), fp, int64s(batch, "text_hash")], ["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash of each row; null is no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def _patterns() -> np.ndarray:
    """For each syndrome, the words of weight up to 2 that have it, padded by repeating one."""
    found: list[list[int]] = [[] for _ in range(LENGTH + 1)]
    found[0].append(0)
    for i in range(LENGTH):
        found[i + 1].append(1 << i)
        for j in range(i):
            found[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
    most = max(map(len, found))
    return np.array([x + x[-1:] * (most - len(x)) for x in found], np.int64)


PATTERNS = _patterns()


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, codeword) for every codeword of the Hamming code within 2 of a word."""
    word = half & np.int64((1 << LENGTH) - 1)
    syndrome = np.zeros(len(word), np.int64)
    for i in range(LENGTH):
        syndrome ^= ((word >> i) & 1) * (i + 1)
    near = word[:, None] ^ PATTERNS[syndrome]
    index = np.broadcast_to(np.arange(len(word))[:, None], near.shape)
    own = np.ones(near.shape, bool)
    own[:, 1:] = near[:, 1:] != near[:, :-1]  # drops the padding
    return index[own], near[own]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for low in range(0, len(fp), 1 << 14):
            part = fp[low : low + (1 << 14)]
            for k in (0, 1):
                index, code = anchors((part >> (32 * k)) & np.int64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(code | np.int64(k << LENGTH)), pa.array(part[index])], ["anchor", "fp"])


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD


def spanning(fps: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links within fps (or between fps and other) join.

    Members are taken one by one against all; whoever is in the largest component needs no turn of
    its own, since any link to another component has an end outside of the largest.
    """
    points = fps if other is None else np.concatenate((fps, other))
    label, a, b = np.arange(len(points)), [], []
    alive, turn = np.ones(len(points), bool), 0
    largest = -1
    while True:
        turn += 1
        if turn & (turn - 1) == 0 or turn % 256 == 0:
            names, sizes = np.unique(label, return_counts=True)
            largest = names[np.argmax(sizes)]
        todo = np.flatnonzero(alive & (label != largest)) if turn > 1 else np.flatnonzero(alive)
        if not len(todo):
            return points[np.array(a, np.int64)], points[np.array(b, np.int64)]
        i = todo[0]
        alive[i] = False
        near = np.flatnonzero(_close(points, points[i]) & (label != label[i]))
        names, first = np.unique(label[near], return_index=True)
        a += [int(i)] * len(names)
        b += near[first].tolist()
        if len(names):
            label[np.isin(label, names)] = label[i]


#: Up to this many fingerprints an anchor's members are compared by shifts.
SMALL = 48


def _compared(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the anchors of sorted rows."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    a, b = [], []
    for low, n in zip(edge[:-1][size > SMALL].tolist(), size[size > SMALL].tolist()):
        x, y = spanning(fp[low : low + n])
        a.append(x)
        b.append(y)
    small = np.repeat((size <= SMALL) & (size > 1), size)
    key, fp = key[small], fp[small]
    for step in range(1, SMALL):
        if not (same := key[step:] == key[:-step]).any():
            break
        near = np.flatnonzero(same)
        near = near[_close(fp[near], fp[near + step])]
        a.append(fp[near])
        b.append(fp[near + step])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor's rows may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _compared(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows < 1 << 18:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held))
        done = int(np.searchsorted(key, key[-1]))
        if done:
            yield out(key[:done], fp[:done])
        held, rows = [(key[done:], fp[done:])], len(key) - done
    if held:
        key, fp = (np.concatenate(x) for x in zip(*held))
        if len(key):
            yield out(key, fp)


#: Members of an anchor that one task takes; of larger anchors, pairs of parts go to tasks.
PART = 1 << 16


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join every two fingerprints with at most THRESHOLD differing bits.

    nodes: fp, distinct. Within an anchor only a spanning forest of the links comes out, never all
    pairs. An anchor of over PART members is cut into parts by a hash, and every two parts meet in
    a task of their own.
    """
    rows = nodes.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    rows = written(rows, "anchored")
    hot = written(rows.groupBy("anchor").count().filter(F.col("count") > PART).select("anchor", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "hot")
    # hot was written: its size is known, and it is broadcast only below Spark's threshold
    rows = rows.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("anchor", F.least(own, k), F.greatest(own, k)))
    rows = rows.select(F.explode(F.when(F.col("parts") > 1, meet).otherwise(F.array("anchor"))).alias("meet"), "fp")
    return rows.repartition("meet").sortWithinPartitions("meet").mapInArrow(_compare, "a long, b long")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, root (of the component) of each row."""
    marks = written(fingerprints(docs), "fingerprints")
    nodes = written(marks.select("fp").distinct(), "nodes")
    stars = components(links(nodes))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return marks.join(written(rooted, "rooted"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document.

    docs: doc_id, text; other columns are ignored. Null and empty texts have the fingerprint 0 and
    link like any other. component_id is the smallest doc_id of the component; rows with a null id
    take part and never name a component unless all of its ids are null. Repeated rows come out as
    often as they went in; an empty table gives none. Copies count once: links are sought between
    distinct fingerprints only.
    """
    rows = written(_named(docs), "components")
    names = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    return rows.join(names, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near duplicates, with their own columns whatever their names: of each component one
    row stays, the first by id (null last), fingerprint and text.

    Rows of one id with different texts are different documents. Rows repeated as a whole are one. Null
    and empty texts are one component. An empty table stays empty.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash"))
    # docs may name its columns like these
    kept = _named(docs.select("doc_id", "text")).groupBy("root").agg(first.alias("one"))
    key = lambda id_, text: F.concat_ws(":", F.coalesce(id_.cast("long").cast("string"), F.lit("")), text.cast("string"))
    kept = written(kept.select(key(F.col("one.doc_id"), F.col("one.text_hash")).alias("simhash_key")).distinct(), "kept")
    own = docs.columns
    # one key for both: the exchange for the join also serves the deduplication
    rows = docs.select(F.struct(*own).alias("simhash_row"), key(F.col("doc_id"), F.xxhash64("text")).alias("simhash_key"))
    rows = rows.join(kept, "simhash_key", "left_semi").dropDuplicates(["simhash_key"])
    return rows.select(*[F.col("simhash_row").getField(c).alias(c) for c in own])
