"""Operators over the whole corpus, against brute force."""

import hashlib
import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeline.llm import line_dedup, mixing, sharding, simhash, suffix_dedup
from tapeline.llm.components import components
from tapeline.llm.fm_index import FMIndex
from tapeline.llm.suffix_array import common_prefixes, refine, search, words_at
from tests.llm.cases import documents, empty, rows, texts


def _id(doc):
    return (doc is not None, doc or 0)


def test_line_dedup(spark):
    docs = documents(spark).filter("doc_id IS NULL OR doc_id < 120 OR doc_id > 90000")
    got = defaultdict(set)
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id].add((r.n_lines, r.n_removed, tuple(x["line"] for x in r.removed or ())))
    lines = []
    for doc, text in texts(docs):
        for k, line in enumerate((text or "").encode().split(b"\n")):
            lines.append(((*_id(doc), k), frozenset(line.lower().split())))
    sets = sorted({x for x in lines if x[1]})
    gone = defaultdict(set)
    for i, (at, s) in enumerate(sets):
        for before, t in sets[:i]:
            if before < at and 5 * len(s & t) >= 4 * len(s | t):
                gone[at[:2]].add(at[2])
                break
    want = defaultdict(set)
    for doc, text in texts(docs):
        own = tuple(sorted(gone[_id(doc)]))
        want[doc].add((0 if text is None else text.count("\n") + 1, len(own), own))
    assert got == want
    assert 2 < sum(len(x) for x in gone.values())
    assert rows(line_dedup.dedup_lines(empty(spark)).drop("removed")) == []
    clean = dict(texts(line_dedup.remove_lines(docs, line_dedup.dedup_lines(docs)).filter("doc_id IN (90017, 90018)")))
    assert clean[90018] == "\n" and clean[90017].count("\n") == 1


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    data = [
        (1, "the quick brown fox jumps"), (5, "the quick brown fox jumps\nunique line one two three"), (5, "another unique first line entirely\nmore text here now"),
        (None, "more text here now"), (None, None), (None, "also the quick fox brown jumps\nend"), (6, ""), (7, None), (8, "the quick brown fox jumps"), (8, "the quick brown fox jumps"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for name in ("text_key", "d", "t", "gone", "removed", "line"):
        docs = docs.withColumn(name, F.lit("extra"))
    found = line_dedup.dedup_lines(docs)
    want = [
        (None, None), (None, "more text here now"), (None, "also the quick fox brown jumps\nend"), (1, ""), (5, "unique line one two three"),
        (5, "another unique first line entirely"), (6, ""), (7, None), (8, ""), (8, ""),
    ]
    assert sorted(map(str, rows(line_dedup.remove_lines(docs, found)))) == sorted(map(str, want))
    assert sorted(r.n_removed for r in found.filter("doc_id = 5").collect()) == [1, 1]
    assert rows(line_dedup.remove_lines(docs.filter("false"), found)) == []


def test_line_dedup_of_many_near_copies(spark):
    """Parts of hot words, and lines that only their second candidate settles."""
    base = [f"w{i}" for i in range(20)]
    lines = [" ".join(base[:k] + [f"new{k}-{j}"] + base[k + 1 :]) for k in range(20) for j in range(6)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    before = line_dedup.PART
    line_dedup.PART = 16
    try:
        got = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed}
    finally:
        line_dedup.PART = before
    assert got == set(range(1, len(lines)))


@pytest.mark.parametrize("part, short", [(1 << 15, 64), (16, 64), (16, 0), (1 << 15, 18)])
def test_line_dedup_counts_every_link(spark, monkeypatch, part, short):
    """Class, number of links and earliest match of every line against brute force, with words in
    parts or not, and lines on either side of the length at which pairs are listed."""
    monkeypatch.setattr(line_dedup, "PART", part)
    monkeypatch.setattr(line_dedup, "SHORT", short)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    monkeypatch.setattr(line_dedup, "VERIFY", 30)
    base = [f"w{i}" for i in range(20)]
    near = [" ".join(base[:k] + [f"new{k}-{j}"] + base[k + 1 :]) for k in range(0, 20, 4) for j in range(6)]
    near += [" ".join(base[:k]) for k in range(14, 20)] + [" ".join(reversed(base)), "A B C D E", "a b c d", "c d e a b", "a b c d e f"]
    more = spark.createDataFrame([(95000 + i // 3, "\n".join(near[i : i + 3])) for i in range(0, len(near), 3)], "doc_id long, text string")
    docs = documents(spark).select("doc_id", "text").filter("doc_id IS NULL OR doc_id < 120 OR doc_id > 90000").unionByName(more)
    first, sets = {}, set()
    for doc, text in texts(docs):
        for k, line in enumerate((text or "").encode().split(b"\n")):
            if words := frozenset(line.lower().split()):
                at = (*_id(doc), k)
                sets.add((at, words))
                first[words] = min(first.get(words, at), at)
    links, classes = defaultdict(set), list(first)
    for i, s in enumerate(classes):
        for t in classes[:i]:
            if 5 * len(s & t) >= 4 * len(s | t):
                links[s].add(first[t])
                links[t].add(first[s])
    members = Counter(s for _, s in sets)
    doc = lambda at: at[1] if at[0] else None
    want_linked = {(doc(at), at[2], doc(first[s]), first[s][2], len(links[s])) for at, s in sets if members[s] > 1 or links[s]}
    want_removed = {(doc(at), at[2], doc(min(b))) for at, s in sets if (b := [x for x in {first[s], *links[s]} if x < at])}
    linked, removed, ids = set(), set(), set()
    for r in line_dedup.dedup_lines(docs).collect():
        linked |= {(r.doc_id, x.line, x.class_doc, x.class_line, x.links) for x in r.linked or ()}
        ids |= {(x.class_id, x.class_doc, x.class_line) for x in r.linked or ()}
        removed |= {(r.doc_id, x.line, x.doc_id) for x in r.removed or ()}
    extra = {(d, k) for d, k, *_ in linked - want_linked}  # the members of rows with one id are counted by row
    assert want_linked <= linked and extra <= {(90003, 0)}
    assert removed == want_removed
    assert len({i for i, *_ in ids}) == len(ids) and max(len(x) for x in links.values()) > 30


def test_line_dedup_of_long_lines(spark, monkeypatch):
    """Links of lines around the widths of parities, in components of one part and of several."""
    monkeypatch.setattr(line_dedup, "WORDS", 3000)
    rng = np.random.default_rng(4)
    lines = []
    for n in (20, 25, 62, 66, 185, 195, 420):
        base = [f"b{n}x{i}" for i in range(n)]
        for k in range(14):
            line = list(base)
            for i in rng.choice(n, k * n // 90, replace=False):
                line[i] = f"r{n}k{k}i{i}"
            lines.append(line + [f"more{i}" for i in range(k % 3)])
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    want = {}
    sets = [frozenset(line) for line in lines]
    for i, s in enumerate(sets):
        near = [j for j, t in enumerate(sets) if j != i and 5 * len(s & t) >= 4 * len(s | t)]
        want[i] = (len({sets[j] for j in near} - {s}), min([j for j in near if j < i], default=None))
    got = {i: (0, None) for i in range(len(lines))}
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id] = (sum(x.links for x in r.linked or ()), min((x.doc_id for x in r.removed or ()), default=None))
    assert got == want and max(x[0] for x in want.values()) > 8


def test_sharding(spark):
    docs = documents(spark)
    got = sharding.shard_documents(docs, 7).collect()
    text = defaultdict(list)
    for doc, t in texts(docs):
        text[doc].append(t)
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"}
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in texts(docs):
        groups[t] += len((t or "").encode()) + 1
    heap = [(0, i) for i in range(7)]
    for size in sorted(groups.values(), reverse=True):
        low, i = heap[0]
        heapq.heapreplace(heap, (low + size, i))
    assert max(load.values()) - min(load.values()) <= 1.01 * (max(heap)[0] - min(heap)[0]) + 64
    whole = spark.createDataFrame([(r.doc_id, r.text_crc32, r.shard) for r in got], "doc_id long, text_crc32 long, shard int")
    joined = whole.join(docs.select("doc_id", "text"), "doc_id").filter("crc32(coalesce(text, '')) = text_crc32")
    assert joined.groupBy("text").agg(F.countDistinct("shard").alias("c")).filter("c > 1").count() == 0
    assert rows(sharding.shard_documents(empty(spark), 3)) == []


def test_bulk_schedule_equals_heap():
    rng = np.random.default_rng(5)
    for _ in range(30):
        classes = [(int(k), int(n), int(k * n)) for k, n in zip(rng.integers(1, 5000, 12), rng.integers(1, 400, 12))]
        classes = list({c[0]: c for c in classes}.values())
        dealt = sharding.schedule(classes, 5)
        load = [sum(dealt[k][i] * k for k, _, _ in classes) for i in range(5)]
        heap = [0] * 5
        for k, n, _ in sorted(classes, reverse=True):
            for _ in range(n):
                heapq.heapreplace(heap, heap[0] + k)
        assert sorted(load) == sorted(heap)
        assert all(sum(dealt[k]) == n for k, n, _ in classes)


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(grams))


def test_simhash(spark):
    docs = documents(spark)
    all_rows = [(d, _fingerprint(t)) for d, t in texts(docs)]
    fps = sorted({f for _, f in all_rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 4 and find(f) != find(g):
                root[find(f)] = find(g)
    first = defaultdict(lambda: None)
    for d, f in all_rows:
        if d is not None and (first[find(f)] is None or d < first[find(f)]):
            first[find(f)] = d
    want = [(d, f"{f:016x}", first[find(f)]) for d, f in all_rows]
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=order) == sorted(want, key=order)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(d for d, _ in texts(kept)) == sorted({first[find(f)] for _, f in all_rows})
    assert rows(simhash.near_duplicates(empty(spark))) == []


def test_keep_first_of_shared_ids(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (None, b), (7, None), (None, None)], "doc_id long, text string")
    assert rows(simhash.keep_first(docs)) == [(3, a), (5, b), (7, None)]
    assert rows(simhash.keep_first(docs.filter("false"))) == []


def test_links_of_a_ball(spark):
    """Thousands of fingerprints around one, hot anchors in parts, and far ones between."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 62))
    near = {center ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(1200)}
    fps = np.array(sorted(near | {int(x) for x in rng.integers(0, 1 << 62, 300)}), np.uint64).view(np.int64)
    before = simhash.PART
    simhash.PART = 64
    try:
        nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
        got = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    finally:
        simhash.PART = before
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count((fps ^ fps[i]).view(np.uint64)) <= 4):
            low, high = sorted((label[i], label[j]))
            label[label == high] = low
    groups = defaultdict(set)
    for f, k in zip(fps.tolist(), label.tolist()):
        groups[k].add(f)
    ours = defaultdict(set)
    for f in fps.tolist():
        ours[got.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}


def _removed(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (_id(r[0]), r[1:]))


def test_suffix_dedup(spark):
    docs = documents(spark)
    for length, sizes in ((400, {}), (60, {"gram": 20, "chunk": 900, "shard": 4000}), (60, {"gram": 20, "part": 2, "shard": 1500})):
        got = sorted(map(tuple, suffix_dedup.remove_repeats(docs, length, **sizes).collect()), key=lambda r: (_id(r[0]), r[1:]))
        assert got == _removed(texts(docs), length), (length, sizes)
    assert rows(suffix_dedup.remove_repeats(empty(spark))) == []


def test_suffix_dedup_says_what_it_cut(spark):
    long = " ".join(f"wörter{i * 7919 % 1000}" for i in range(60))
    short = " ".join(f"w{i}" for i in range(60))
    data = [(1, "one " + long + "; end"), (2, long), (3, "start\n" + long + " three " + short), (4, short + " four"), (5, "é" * 150), (6, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    n = len(long.encode())
    assert n > 400 > len(short.encode())
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs).collect()}
    assert {k: [tuple(x) for x in r.spans] for k, r in got.items()} == {1: [(4, 4 + n)], 2: [(0, n)], 3: [(6, 6 + n)], 4: [], 5: [], 6: []}
    assert {k: bytes(r.kept).decode() for k, r in got.items()} == {1: "one ; end", 2: "", 3: "start\n three " + short, 4: data[3][1], 5: data[4][1], 6: ""}
    digests = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.cut_repeats(docs)).collect()}
    assert [digests[k].spans for k in (1, 2, 4)] == [f"4:{4 + n}", f"0:{n}", ""]
    want = {r[0]: r for r in _removed(data, 400)}
    assert {k: tuple(r)[:5] for k, r in digests.items()} == want
    # texts cut within characters, over slices of texts
    docs = documents(spark)
    got = suffix_dedup.cut_repeats(docs, 61, gram=20, chunk=900).collect()
    kept = [(r.doc_id, r.n_bytes, sum(x.high - x.low for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(kept, key=lambda r: (_id(r[0]), r[1:])) == _removed(texts(docs), 61)


def test_suffix_array():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 100, 900), np.tile(rng.integers(97, 123, 50), 9), np.full(70, 98)]).astype(np.uint8)
    text = data.tobytes()
    words = words_at(data)
    sa, _ = refine(words, 8)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = common_prefixes(words, sa, 64, lanes=16)
    for k in range(1, len(sa)):
        a, b = text[sa[k - 1] :], text[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 64)
    wanted = np.frombuffer(text[100:150] + b"zzzzzzzzzzzzz" + b"\0" * 40, np.uint8)
    slot = search(words, sa, words_at(wanted), np.array([0, 50]), 13)
    assert text[sa[slot[0]] :][:13] == text[100:113] and slot[1] == len(sa)


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 700)
    index = FMIndex(text, 6)
    patterns = rng.integers(1, 6, (200, 4))
    lengths = rng.integers(1, 5, 200)
    low, high = index.find(patterns, lengths)
    for p, n, i, j in zip(patterns, lengths, low, high):
        want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(i, j)).tolist()) == want


def test_mixing(spark):
    docs = documents(spark).filter("doc_id IS NULL OR doc_id < 150 OR doc_id > 90000")
    weights = {"src0": 0.5, "src1": 0.0, "src2": 9.0}
    got = mixing.mix_sources(docs, weights, 0.05, epochs=3.0).collect()
    sources = Counter((r.source or "") for r in docs.collect())
    w = {s: weights.get(s, 0.05) for s in sources}
    total = sum(sources.values())
    copies = Counter((r.doc_id, r.text, r.source) for r in got)
    for r in docs.collect():
        s, n = r.source or "", 0
        rate = w[s] / sum(w.values()) * 3.0 * total / sources[s]
        parts = max(1, math.ceil(rate / mixing.PART))
        for part in range(parts):
            u = int(hashlib.md5(f"17:{'' if r.doc_id is None else r.doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while u >= c and k < mixing.PART_TERMS:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        same = sum((x.doc_id, x.text, x.source) == (r.doc_id, r.text, r.source) for x in docs.collect()) if r.doc_id in (90003, None) else 1
        assert copies[(r.doc_id, r.text, r.source)] == n * same
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys) and not any(r.source == "src1" for r in got)
    share = sum(r.source == "src2" for r in got) / len(got)
    assert abs(share - 9.0 / sum(w.values())) < 0.1
    assert rows(mixing.mix_sources(empty(spark), weights).select("doc_id")) == []
