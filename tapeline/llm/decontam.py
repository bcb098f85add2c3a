"""Benchmark decontamination: an FM-index per training shard, searched for all benchmark windows.

Training shards are runs of documents of up to SHARD_BYTES. In a shard, words become the numbers of
the benchmark's own vocabulary. A window can only lie where every word and every two neighbours
also stand side by side in some benchmark text, so the index is built over just those runs of words
(nothing that could match is left out). All windows are searched backward at once through the
wavelet matrix, located by the sampled suffix positions, checked against the words' bytes, and
merged into removal spans. Benchmarks are a stated query set: they are read in blocks of up to
BLOCK_BYTES by hash. One block is searched in one pass; of more, each has a pass of its own, and its
broadcast is released before the next is made, so that no size is assumed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_class, int64s, prefix_hash, slices, span_hashes, spaced, text_bytes, word_bounds, written
from .fm_index import FMIndex

WINDOW, SHARD_BYTES, BLOCK_BYTES = 13, 2 << 20, 16 << 20
#: Bytes of words: digits, letters, and all beyond ASCII.
WORD = byte_class(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def _cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return _words(data, at, 0, len(raw))


def _words(data, at, low, high):
    """Lower-cased buffer, start, end and hash of each word, and the row of each word."""
    buffer, rows = spaced(data, at, low, high)
    buffer = LOWER[buffer]
    start, end = word_bounds(buffer, WORD)
    return buffer, start, end, span_hashes(prefix_hash(buffer), start, end), np.searchsorted(rows, start, "right") - 1


class Windows:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        buffer, start, end, hashes, row = _cut([text for _, text in items])
        text = buffer.tobytes()
        words = [text[i:j] for i, j in zip(start.tolist(), end.tolist())]
        self.number = {w: k + 2 for k, w in enumerate(sorted(set(words)))}  # 0 ends, 1 separates
        ids = np.array([self.number[w] for w in words], np.int64)
        self.size = len(self.number) + 2
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], self.hashes[1:] != self.hashes[:-1]))) if len(order) else order
        self.hashes, self.ids = self.hashes[first], ids[order][first]
        near = np.flatnonzero(row[1:] == row[:-1])
        self.pairs = np.unique(ids[near] * self.size + ids[near + 1])
        owners: dict[tuple, set[str]] = defaultdict(set)
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        for k, (item, _) in enumerate(items):
            own = ids[bounds[k] : bounds[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners[tuple(own[i : i + window])].add(item)
        keys = list(owners)
        self.owners = [sorted(owners[k]) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.array([list(k) + [0] * (window - len(k)) for k in keys], np.int64).reshape(len(keys), window)

    def runs(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (0: not a benchmark word), and which words lie in long enough runs."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == hashes, self.ids[at], 0)
        near = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0) & (row[1:] == row[:-1]))
        pair = ids[near] * self.size + ids[near + 1]
        known = np.searchsorted(self.pairs, pair)
        near = near[(known < len(self.pairs)) & (self.pairs[np.minimum(known, len(self.pairs) - 1)] == pair)] if len(self.pairs) else near[:0]
        linked = np.zeros(len(ids) + 1, bool)
        linked[near + 1] = True  # to the word before
        begin = np.flatnonzero(~linked[:-1])
        length = np.diff(np.append(begin, len(ids)))
        keep = np.repeat((length >= self.lengths.min()) & (ids[begin] > 0), length)
        return ids, keep

    def search(self, hashes, row, words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, window number) of every occurrence; words(i): the bytes of word i."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(hashes):
            return none, none
        ids, keep = self.runs(hashes, row)
        at = np.flatnonzero(keep)
        if not len(at):
            return none, none
        symbols = np.array([self.number.get(words(i), 1) for i in at.tolist()], np.int64)  # by bytes: exact
        apart = np.flatnonzero((np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])) + 1
        symbols, at = np.insert(symbols, apart, 1), np.insert(at, apart, -1)
        index = FMIndex(symbols, self.size)
        low, high = index.find(self.patterns, self.lengths)
        count = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return at[index.locate(rows)], np.repeat(np.arange(len(count)), count)


def _scan(blocks, shard_bytes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch)
            ids = int64s(batch, "doc_id")
            for low, high in slices(at, shard_bytes):
                buffer, start, end, hashes, row = _words(data, at, low, high)
                text = buffer.tobytes()
                cover = np.zeros(len(start) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(high - low)]
                for block in blocks:
                    windows = block.value
                    where, which = windows.search(hashes, row, lambda i: text[start[i] : end[i]])
                    np.add.at(cover, where, 1)
                    np.add.at(cover, where + windows.lengths[which], -1)
                    for doc, w in set(zip(row[where].tolist(), which.tolist())):
                        items[doc].update(windows.owners[w])
                hit = np.cumsum(cover)[:-1] > 0
                n = high - low
                n_words = np.bincount(row, minlength=n).astype(np.int64)
                n_hit = np.bincount(row[hit], minlength=n).astype(np.int64)
                spans: list[list[dict]] = [[] for _ in range(n)]
                base = np.concatenate(([0], np.cumsum(n_words)))
                turn = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (row[1:] != row[:-1])))) if len(hit) else []
                stop = np.flatnonzero(hit & np.concatenate((~hit[1:] | (row[1:] != row[:-1]), [True]))) if len(hit) else []
                for i, j in zip(turn, stop):
                    spans[row[i]].append({"start": int(i - base[row[i]]), "end": int(j + 1 - base[row[i]])})
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, n), pa.array(n_words), pa.array(n_hit),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
                )

    return scan


def _word_counts(shard_bytes):
    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch)
            counts = [np.bincount(_words(data, at, low, high)[4], minlength=high - low) for low, high in slices(at, shard_bytes)]
            n = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["doc_id", "key", "n_words"])

    return word_counts


def query_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator:
    """A broadcast of the Windows of each block of items, by a hash of the text, of about block_bytes
    of text. One at a time: a block is released when the next is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text IS NOT NULL")
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        block = items.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], window))
        yield block, n
        block.unpersist()


def _merged(spans):
    """Sorted spans, with those that touch or overlap as one."""
    span = "array<struct<start:int,end:int>>"
    last = lambda acc: F.element_at(acc, -1)

    def put(acc, x):
        joined = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.sort_array(spans), F.array().cast(span), put)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings), spans (merged, in words, end exclusive).

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts
    have no words and no hits. A null item_id is the item ''. Items of one id are one item. Repeated
    documents have a row each; empty tables give no rows or no hits.
    """
    rows, passes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    for block, n in query_blocks(benchmark, window, block_bytes):
        if n == 1:
            return rows.mapInArrow(_scan([block], shard_bytes), SCHEMA)
        numbered = rows.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("doc_id"), "text")
        found = numbered.mapInArrow(_scan([block], shard_bytes), SCHEMA).filter("n_hit > 0").select(F.col("doc_id").alias("key"), "item_ids", "spans")
        passes.append(written(found, "block-hits"))
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    # repeated rows have the same hits: sets make them one
    hits = hits.select("key", F.explode("spans").alias("span"), "item_ids").groupBy("key").agg(
        F.collect_set("span").alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )
    hits = hits.select("key", "item_ids", _merged(F.col("all")).alias("spans"))
    keyed = rows.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("key"), "text")
    counted = keyed.mapInArrow(_word_counts(shard_bytes), "doc_id long, key long, n_words long")
    whole = counted.join(hits, "key", "left")
    none = F.array().cast("array<string>")
    return whole.select(
        "doc_id", "n_words", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their own columns.

    Null and empty texts stay, repeated rows stay or go together, and an empty table stays empty. A
    benchmark of one block needs no shuffle; of more, the ids and hashes of the contaminated go into one
    anti-join."""
    for block, n in query_blocks(benchmark, window, block_bytes):
        if n > 1:
            break
        scan = _scan([block], shard_bytes)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(scan([batch]))
                if found:
                    n_words, n_hit = (np.concatenate([x.column(k).to_numpy() for x in found]) for k in (1, 2))
                    yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

        return docs.mapInArrow(clean, docs.schema)
    own = docs.columns
    marked = docs.select(F.struct(*own).alias("row"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("key"), "text")
    found = contamination(marked.select(F.col("key").alias("doc_id"), "text"), benchmark, window, shard_bytes, block_bytes)
    gone = found.filter(is_contaminated()).select(F.col("doc_id").alias("key")).distinct()
    return marked.join(gone, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in own])
