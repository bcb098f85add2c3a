"""The pipeline on the smallest given tables, against all of its stages in plain Python."""

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from tapeline.llm import mixing, queries
from tests.llm.cases import SF, documents
from tests.llm.test_corpus_ops import _fingerprint

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _low(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _good(text):
    """Quality: the base rules, and those of symbols, repeated lines and word lengths."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines))
    if len(w) < 10 or 100 * len(cover) > 20 * len(w):
        return False
    return not (4 * symbols > len(w) or (dup >= 5 and 2 * dup > len(lines)) or chars < 2 * len(w) or chars > 20 * len(w))


def _first_of_each(docs):
    """Near duplicates: of each component of fingerprints within 4 bits, the row with the smallest id."""
    fps = {r.doc_id: _fingerprint(r.text) for r in docs}
    distinct, group = sorted(set(fps.values())), {}
    for f in distinct:
        if f in group:
            continue
        group[f], todo = f, [f]
        while todo:
            g = todo.pop()
            for h in distinct:
                if h not in group and (g ^ h).bit_count() <= 4:
                    group[h] = f
                    todo.append(h)
    least = {}
    for r in docs:
        root = group[fps[r.doc_id]]
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    return [r for r in docs if least[group[fps[r.doc_id]]] == r.doc_id]


def _clean(docs, bench):
    windows = set()
    for text in bench:
        w = _low(text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    sizes, out = {len(x) for x in windows}, []
    for r in docs:
        w, hit = _low(r.text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def _copies(docs):
    sources = Counter(r.source or "" for r in docs)
    weight = {s: queries.MIX.get(s, queries.MIX_DEFAULT) for s in sources}
    out = Counter()
    for r in docs:
        rate = weight[r.source or ""] / sum(weight.values()) * len(docs) / sources[r.source or ""]
        parts = max(1, math.ceil(rate / mixing.PART))
        for part in range(parts):
            u = int(hashlib.md5(f"17:{r.doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while u >= c and k < mixing.PART_TERMS:
                k += 1
                p *= rate / parts / k
                c += p
            out[r.doc_id] += k
    return +out


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = [r for r in docs if _good(r.text)]
    single = _first_of_each(good)
    clean = _clean(single, bench)
    copies = _copies(clean)
    assert len(docs) > len(good) > len(single) > len(clean) > 0 and len(set(copies.values())) > 2
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == copies
    text = {r.doc_id: r.text or "" for r in docs}
    place, slots, load = defaultdict(set), defaultdict(list), Counter({k: 0 for k in range(16)})
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1
        place[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in place.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for doc, n in copies.items():
        groups[text[doc]] += n * (len(text[doc].encode()) + 1)
    heap = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert max(load.values()) - min(load.values()) <= 1.02 * (max(heap) - min(heap)) + 1024


def test_stages_keep_columns_of_any_names(spark):
    """Rows with nulls in every column, repeated rows and clashing names pass each stage with their own columns."""
    docs = documents(spark).withColumn("id", F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.filter("key = 'extra' AND id = 7").count() == out.count() > 0, name
