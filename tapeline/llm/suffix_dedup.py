"""Removal of repeated byte strings with suffix arrays.

A string of LENGTH bytes is removed wherever it stands if it starts at two places or more. Suffix
arrays of the whole corpus would have to be compared with each other, so strings are first dealt to
shards such that equal strings meet:

1. Each string is owned by an anchor: of the GRAM-byte grams in it, the one with the smallest hash
   (leftmost of equals). Equal strings have equal anchors. An anchor owns a run of neighbouring
   strings; the text that they cover is a snippet (about 570 bytes, one for every 170 bytes of text).
2. Equal snippets are counted over the corpus before anything moves. A snippet that occurs twice
   makes all its strings repeats; an anchor that occurs once has none. Only anchors with several
   different snippets are open, and one copy of each such snippet goes to its anchor's shard.
3. A shard builds the suffix array of its snippets by Larsson-Sadakane refinement, and neighbours
   whose common prefix (Kasai) has LENGTH bytes are equal strings.
4. An anchor with very many different snippets is cut into shards of about PART snippets. A string
   that reaches from STEP * k to STEP * (k + 1) bytes before the anchor contains its core: the bytes
   that all such strings share. Cores are few (one for STEP strings of a snippet), and only a core that
   several shards have can hide a string that several shards have. Each shard hands on one string of
   every kind with such a core, in suffix order, as a digest; shards are merged by binary search over
   the sorted digests of all. Most strings of near copies end at the core and hand on nothing.
5. Strings found are mapped back to all texts with the snippet, merged, and cut out.

Nothing depends on the documents' order, and no step holds more than a part of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hash, slices, text_bytes, written
from .suffix_array import common_prefixes, refine, words_at

LENGTH, GRAM, PART, STEP = 400, 64, 2048, 16
#: Bytes of text that a task looks at together, and of snippets in one suffix array.
CHUNK, SHARD = 1 << 20, 1 << 20
_PLACE = np.uint64((1 << 31) - 1)
SNIPPETS = "anchor long, snippet binary, doc binary, low int, high int"


def owners(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string start: the place of its anchor. And the hash of the gram at each place."""
    sums = prefix_hash(data)
    n = len(data) - gram + 1
    h = mix((sums[gram:] - sums[:-gram]) * powers(len(data))[1][:n])
    key = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    w = length - gram + 1
    rows = -(-n // w)
    block = np.full(rows * w, ~np.uint64(0))
    block[:n] = key
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1  # strings
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & _PLACE).astype(np.int64), h


def _snippets(length: int, gram: int, chunk: int):
    def cut(data: np.ndarray, at: np.ndarray, keys: list[bytes], shift: int, out: list) -> None:
        """data: whole texts (or a piece of one that begins at shift); at: where each begins and ends."""
        if len(data) < length:
            return
        own, h = owners(data, length, gram)
        start = np.arange(len(own))
        row = np.searchsorted(at, start, "right") - 1
        inside = start + length <= at[row + 1]
        start, row = start[inside], row[inside]
        if not len(start):
            return
        own = own[start]
        turn = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]))))
        low, high = start[turn], start[np.append(turn[1:], len(start)) - 1]
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
        marks = h[own[turn]].view(np.int64)
        for a, i, j, r in zip(marks.tolist(), low.tolist(), high.tolist(), row[turn].tolist()):
            base = int(at[r]) - shift
            out.append((a, digest(view[i : j + length]), keys[r], i - base, j - base))

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch)
            for low, high in slices(at, chunk):
                out: list[tuple] = []
                part = data[at[low] : at[high]]
                keys = [hashlib.sha256(data[at[i] : at[i + 1]]).digest()[:16] if at[i + 1] - at[i] >= length else b"" for i in range(low, high)]
                if high - low > 1 or len(part) <= 2 * chunk:
                    cut(part, at[low : high + 1] - at[low], keys, 0, out)
                else:
                    for k in range(0, len(part) - length + 1, chunk):
                        piece = part[k : k + chunk + length - 1]
                        cut(piece, np.array([0, len(piece)]), keys, k, out)
                columns = list(zip(*out)) if out else [[], [], [], [], []]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "snippet", "doc", "low", "high"])

    return snippets


def repeats(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some snippets in suffix order: snippet, place in it, number of the string's
    kind, and how many strings are of that kind."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    words = words_at(data)
    sa, _ = refine(words, 8)
    kind = np.cumsum(common_prefixes(words, sa, length) < length)
    row = np.searchsorted(begin, sa, "right") - 1
    place = sa - begin[row]
    whole = place + length <= size[row]
    row, place, kind = row[whole], place[whole], kind[whole]
    _, kind, count = np.unique(kind, return_inverse=True, return_counts=True)
    return row, place, kind, count[kind]


def cores(text: bytes, length: int, gram: int) -> tuple[int, int, list[bytes]]:
    """Of a snippet: the place of its anchor, the number of the first core, and a digest of each core."""
    step = min(STEP, length // 4)
    own = int(owners(np.frombuffer(text, np.uint8), length, gram)[0][0])
    first, last = max(0, own - (len(text) - length)) // step, own // step
    view, size = memoryview(text), length - step + 1
    return own, first, [xxhash.xxh3_128_digest(view[own - step * k : own - step * k + size]) for k in range(first, last + 1)]


def _cores(length: int, gram: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(core, meet) for meet, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for core in cores(text, length, gram)[2]}
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.binary()), pa.array([m for _, m in found], pa.int64())], ["core", "meet"])

    return look


def _found(length: int, gram: int, shard: int):
    """Rows come sorted by (meet, text or core, snippet), a meet's cores first; repeated rows of a snippet
    count once."""
    names = ["anchor", "snippet", "low", "high", "digest", "known"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    step = min(STEP, length // 4)

    def look(rows: list[tuple], shared: set[tuple[int, bytes]]) -> pa.RecordBatch:
        meets, anchor, snippet, text, parts = zip(*rows)
        row, place, kind, count = repeats(list(text), length)
        hit = count > 1
        order = np.lexsort((place[hit], row[hit]))
        r, p = row[hit][order], place[hit][order]
        turn = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)))) if len(r) else np.zeros(0, np.int64)
        last = np.append(turn[1:], len(r)) - 1
        out = [(anchor[r[i]], snippet[r[i]], int(p[i]), int(p[j]), None, True) for i, j in zip(turn.tolist(), last.tolist() if len(r) else [])]
        split = np.array([n > 1 for n in parts])
        if split.any():
            # cores that other shards have, by snippet and number
            own, most = np.zeros(len(text), np.int64), length // step + 1
            other = np.zeros((len(text), most), bool)
            for i in np.flatnonzero(split).tolist():
                own[i], first, marks = cores(text[i], length, gram)
                for k, mark in enumerate(marks, first):
                    other[i, k] = (meets[i], mark) in shared
            # one string of each kind, for the other shards of the anchor
            lead = np.concatenate(([True], kind[1:] != kind[:-1])) & split[row]
            lead[lead] = other[row[lead], (own[row[lead]] - place[lead]) // step]
            for i in np.flatnonzero(lead).tolist():
                t, q = text[row[i]], int(place[i])
                out.append((anchor[row[i]], snippet[row[i]], q, q, xxhash.xxh3_128_digest(t[q : q + length]), bool(count[i] > 1)))
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shared: set[tuple[int, bytes]] = set()
        size, last, seen = 0, None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for meet, anchor, snippet, text, parts, core in zip(*columns):
                if meet != last and size >= shard:
                    yield look(held, shared)
                    held, size, shared = [], 0, set()
                last = meet
                if core is not None:
                    shared.add((meet, core))
                elif (meet, anchor, snippet) != seen:
                    seen = (meet, anchor, snippet)
                    held.append((meet, anchor, snippet, text, parts))
                    size += len(text)
        if held:
            yield look(held, shared)

    return found


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, anchor, snippet, low, known) sorted by digest: the strings not known yet whose
    digest another shard has too, by binary search over all digests of the batch."""
    held = None
    for batch in _with_end(batches):
        if batch is None:
            whole, held = held, None
        else:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            digests = table.column(0).to_pylist()
            cut = len(digests)
            while cut and digests[cut - 1] == digests[-1]:
                cut -= 1
            whole, held = table.slice(0, cut), table.slice(cut)
        if whole is None or not whole.num_rows:
            continue
        key = np.array([int.from_bytes(d[:8], "big") for d in whole.column(0).to_pylist()], np.uint64)
        rest = np.array([int.from_bytes(d[8:], "big") for d in whole.column(0).to_pylist()], np.uint64)
        pair = np.empty(len(key), [("a", np.uint64), ("b", np.uint64)])
        pair["a"], pair["b"] = key, rest
        both = np.searchsorted(pair, pair, "right") - np.searchsorted(pair, pair, "left") > 1
        new = both & ~whole.column(4).to_numpy()
        got = whole.filter(pa.array(new)).combine_chunks()
        yield from pa.table({"anchor": got.column(1), "snippet": got.column(2), "low": got.column(3), "high": got.column(3)}).to_batches()


def _with_end(batches):
    yield from batches
    yield None


def _cut(length: int, chunk: int):
    names = ["doc_id", "n_bytes", "spans", "kept"]
    kinds = (pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch)
            found = batch.column(batch.schema.get_field_index("spans"))
            for first, last in slices(at, chunk):
                out = []
                for i, spans in enumerate(found.slice(first, last - first).to_pylist(), first):
                    text = data[at[i] : at[i + 1]]
                    runs, end, kept = merged(spans, length), 0, []
                    for low, high in runs:
                        kept.append(text[end:low].tobytes())
                        end = high
                    kept.append(text[end:].tobytes())
                    out.append((len(text), [{"low": low, "high": high} for low, high in runs], b"".join(kept)))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names)

    return cut


def merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the strings that start in each span (low to high)."""
    out: list[list[int]] = []
    for low, high in sorted({(s["low"], s["high"]) for s in spans or ()}):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """doc (the first 16 bytes of the text's SHA-256), spans: ranges of starts of repeated strings."""
    rows = docs.select("text").mapInArrow(_snippets(length, gram, chunk), SNIPPETS)
    # copies of a text are one row from here on
    rows = written(rows.groupBy("anchor", "snippet", "doc", "low", "high").agg(F.count("*").alias("n")), "snippets")
    kinds = rows.groupBy("anchor", "snippet").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "low", "high")).alias("one"))
    kinds = written(kinds, "kinds")
    many = kinds.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("different")).filter(F.col("all") > 1)
    kinds = written(kinds.join(many, "anchor"), "repeated")
    parts = F.ceil(F.col("different") / part).cast("int")
    wanted = kinds.filter("different > 1").select(
        F.col("one.doc").alias("doc"), F.struct("anchor", "snippet", F.col("one.low").alias("low"), F.col("one.high").alias("high"), parts.alias("parts")).alias("x")
    )
    wanted = written(wanted.groupBy("doc").agg(F.collect_list("x").alias("wanted")), "wanted")
    texts = docs.select("text", _key().alias("doc")).filter(F.octet_length("text") >= length).join(wanted, "doc")
    texts = texts.select(F.explode("wanted").alias("x"), F.encode("text", "UTF-8").alias("bytes"))
    cut = F.substring(F.col("bytes"), F.col("x.low") + 1, F.col("x.high") - F.col("x.low") + F.lit(length))
    meet = F.when(F.col("x.parts") > 1, F.xxhash64("x.anchor", F.pmod(F.xxhash64("x.snippet"), F.col("x.parts")))).otherwise(F.col("x.anchor"))
    texts = written(texts.select(meet.alias("meet"), "x.anchor", "x.snippet", cut.alias("text"), "x.parts"), "snippet-texts")
    # cores that two shards or more have; at most a row a shard of an anchor for each
    shared = texts.filter("parts > 1").select("meet", "text").mapInArrow(_cores(length, gram), "core binary, meet long")
    shared = shared.groupBy("core").agg(F.collect_set("meet").alias("meets")).filter(F.size("meets") > 1).select(F.explode("meets").alias("meet"), "core")
    both = texts.withColumn("core", F.lit(None).cast("binary")).unionByName(shared, allowMissingColumns=True)
    found = both.repartition("meet").sortWithinPartitions("meet", F.col("core").isNull(), "anchor", "snippet").mapInArrow(
        _found(length, gram, shard), "anchor long, snippet binary, low int, high int, digest binary, known boolean"
    )
    found = written(found, "found")
    crossed = found.filter("digest IS NOT NULL").select("digest", "anchor", "snippet", "low", "known")
    crossed = crossed.repartition("digest").sortWithinPartitions("digest").mapInArrow(_merge, "anchor long, snippet binary, low int, high int")
    hits = found.filter("digest IS NULL").select("anchor", "snippet", "low", "high").unionByName(crossed)
    hits = hits.unionByName(kinds.filter("n > 1").select("anchor", "snippet", F.lit(0).alias("low"), (F.col("one.high") - F.col("one.low")).alias("high")))
    hits = written(hits.groupBy("anchor", "snippet").agg(F.collect_set(F.struct("low", "high")).alias("hits")), "hits")
    spans = rows.join(hits, ["anchor", "snippet"]).select("doc", F.col("low").alias("base"), F.explode("hits").alias("x"))
    spans = spans.select("doc", F.struct((F.col("base") + F.col("x.low")).alias("low"), (F.col("base") + F.col("x.high")).alias("high")).alias("span"))
    return spans.groupBy("doc").agg(F.collect_list("span").alias("spans"))


def _key():
    return F.substring(F.unhex(F.sha2("text", 256)), 1, 16)


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (array of low, high: the maximal removed runs, in bytes, end exclusive),
    kept (the remaining bytes; a cut may part a character).

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes; null and empty texts have
    none. A string counts wherever it starts, so repeated rows and copies remove each other wholly
    (from `length` bytes on). Texts below `length` bytes are left alone. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = written(repeated_spans(rows, length, gram, part, chunk, shard), "spans")
    rows = rows.withColumn("doc", _key()).join(spans, "doc", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(length, chunk), "doc_id long, n_bytes long, spans array<struct<low: long, high: long>>, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    """Of cut_repeats: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (low:high, comma-joined)."""
    span = F.transform("spans", lambda x: F.concat(x["low"].cast("string"), F.lit(":"), x["high"].cast("string")))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.array_join(span, ",").alias("spans"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of cut_repeats."""
    return digest(cut_repeats(docs, length, gram, part, chunk, shard)).drop("spans")
