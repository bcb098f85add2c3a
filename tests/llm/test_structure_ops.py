"""Conversation repair, the Merkle manifest and language identification against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import conversations, language, merkle
from tests.llm.cases import SF, documents, rows

# ---------------------------------------------------------------- conversations

FORM = re.compile(r"(s?(ua)+)?\Z")


def scripts(given, inserts, costs):
    """(cost, letters, repaired rows) of every edit script of rows (role, text, fault) with up to so many inserts, by enumeration."""
    rerole, delete, insert, cut = costs
    for places in itertools.product(range(inserts + 1), repeat=len(given) + 1):
        if sum(places) > inserts:
            continue
        for roles in itertools.product(("user", "assistant"), repeat=sum(places)):
            for acts in itertools.product(("D", "K", "Ruser", "Rassistant"), repeat=len(given)):
                cost, letters, out, new = insert * sum(places), [], [], iter(roles)
                for k in range(len(given) + 1):
                    for _ in range(places[k]):
                        letters.append("I")
                        out.append((next(new), ""))
                    if k == len(given):
                        break
                    role, text, fault = given[k]
                    letters.append(acts[k][0])
                    if acts[k] == "D":
                        cost += delete
                        continue
                    if fault in ("blank", "duplicate"):
                        break
                    cost += (acts[k] != "K") * rerole + (fault == "truncated") * cut
                    out.append((role if acts[k] == "K" else acts[k][1:], text))
                else:
                    continue
                if k == len(given) and FORM.match("".join(r[:1] or "?" for r, _ in out)):
                    yield cost, "".join(letters), out


def coded(given):
    faults = {"": 0, "truncated": conversations.CUT, "blank": conversations.GONE, "duplicate": conversations.GONE}
    return bytes({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * faults[fault] for role, _, fault in given)


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_least_edits(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(150):
        given = [(draw.choice(["system", "user", "assistant", "user", "assistant", "tool"]), "x", draw.choice(["", "", "truncated", "blank"])) for _ in range(draw.randrange(5))]
        assert conversations.least_edits(coded(given)) == min(scripts(given, 1, (1, 2, 5, 5)))[:2], given


def test_least_edits_with_inserts(monkeypatch):
    """Where inserts are cheap, scripts of several lengths compete, and shorter audits rank by their end."""
    for costs in ((3, 4, 1, 5), (2, 2, 1, 1), (9, 3, 2, 0)):
        for name, cost in zip(("REROLE", "DELETE", "INSERT", "TRUNCATED"), costs):
            monkeypatch.setattr(conversations, name, cost)
        monkeypatch.setattr(conversations, "EDGES", [[conversations._consuming(c, s) for s in range(4)] for c in range(12)])
        draw, most = random.Random(sum(costs)), 0
        for _ in range(40):
            given = [(draw.choice(["system", "user", "assistant"]), "x", draw.choice(["", "", "truncated", "blank"])) for _ in range(draw.randrange(4))]
            assert conversations.least_edits(coded(given)) == min(scripts(given, 4, costs))[:2], (costs, given)
            most = max(most, conversations.most_inserts(coded(given)))
        assert most > 0


def damaged(table):
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def expected(table, rows_):
    for conv in dict.fromkeys(r[0] for r in table):
        mine = sorted((r for r in rows_ if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        given, seen = [], set()
        for _, _, role, text in mine:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            given.append((role, text, fault))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = [sum(f == k for *_, f in given) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:]))
        cost, letters, out = min(scripts(given, 0, (1, 2, 5, 5))) if given else (0, "", [])
        yield conv, gaps, *count, illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_conversations_against_enumeration(spark):
    draw = random.Random(5)
    table = [(None, 0, "user", "Hi."), (None, None, "assistant", None), (7000, None, None, "x"), (7000, None, None, "x"), (7001, 3, "", " \n"), (7002, 5, "User", "Yes!"), (7002, 5, "Assistant", "No?\n"), (7003, -2, "assistant", "ÀÉ 😀.")]
    for conv in range(60):
        for turn in range(draw.randrange(1, 6)):
            table.append((conv, draw.choice([turn, turn + 3, None, turn]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool"]), draw.choice(["One.", "Two? ", "cut", "", None, "Three!\n\n", "a\nb."])))
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    for name in ("kind", "code", "row", "letters", "key", "digest", "position"):
        frame = frame.withColumn(name, F.lit("extra"))
    want = sorted(map(str, expected(table, list(damaged(table)))))
    assert sorted(str(tuple(r)) for r in conversations.report(frame, conversations.damage(frame)).collect()) == want
    # without damage as well, and the repaired rows themselves
    plain = frame.filter("conv_id < 20 OR conv_id >= 7000")
    own = [r for r in table if r[0] is not None and (r[0] < 20 or r[0] >= 7000)]
    clean = [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in own]
    assert sorted(str(tuple(r)) for r in conversations.report(plain, plain).collect()) == sorted(map(str, expected(own, clean)))
    empty = frame.filter("false")
    assert rows(conversations.report(empty, conversations.damage(empty))) == []


def test_repaired_rows_of_a_long_conversation(spark):
    n = 5000
    frame = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role", "concat('text ', id, IF(id % 7 = 0, '', '.')) AS text")
    found = conversations.written(conversations.summaries(frame), "long")
    (one,) = found.collect()
    assert one.truncated == len(range(0, n, 7)) and len(one.audit) == n and one.gaps == 0
    out = conversations.repaired(frame, found).orderBy("position").collect()
    assert FORM.match("".join(r.role[0] for r in out)) and [r.position for r in out] == list(range(len(out)))
    kept = [k for k, letter in enumerate(one.audit) if letter != "D"]
    assert [r.text for r in out] == [f"text {k}{'' if k % 7 == 0 else '.'}" for k in kept]


# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(table):
    """Proofs by building the whole tree in memory. table: rows (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def build(nodes):
        """The levels of a tree from the leaves upwards."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    langs = sorted({r[2] for r in table}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in table if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    levels = {lang: build([leaf(r) for r in trees[lang]]) for lang in langs}
    top = build([levels[lang][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        for i, row in enumerate(trees[lang]):
            path = []
            for place, all_levels in ((i, levels[lang]), (k, top)):
                for level in all_levels[:-1]:
                    start = place // 8 * 8
                    path.append((place - start, level[start : start + 8]))
                    place //= 8
            fake = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            node = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))) if fake else leaf(row)
            for digit, run in path:
                node = sha(*run[:digit], node, *run[digit + 1 :])
            proof = sha(*[x for digit, run in path for j, x in enumerate(run) if j != digit])
            yield row[0], leaf(row), levels[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifests_agree(frame):
    table = [tuple(r) for r in frame.select(*COLUMNS).collect()]
    got = merkle.manifest(frame).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(table)))


def test_manifest_against_a_tree_in_memory(spark):
    docs = documents(spark)
    manifests_agree(docs.withColumn("rank", F.lit("x")).withColumn("tree", F.lit("x")).withColumn("path", F.lit("x")).withColumn("height", F.lit(9)))
    many = spark.range(80).select((F.col("id") % 30).alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("l"), (F.col("id") % 11).cast("string")).alias("lang"), F.lit(1).alias("n_chars"), F.lit("Same Text").alias("text"))
    manifests_agree(many)  # 11 trees, so a tree of languages of two levels, and repeated rows


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_of_one_language(spark, n):
    manifests_agree(spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "CAST(NULL AS STRING) AS lang", "1 AS n_chars", "concat('Text ', id) AS text"))


def test_manifest_of_nothing(spark):
    assert rows(merkle.manifest(documents(spark, False).filter("false"))) == []


# ---------------------------------------------------------------- languages


def test_codewords_lie_apart():
    for n in (2, 3, 4, 6, 7, 20, 60):
        code = language.codewords(n)
        assert set(np.unique(code)) == {-1.0, 1.0} and (np.abs(code.sum(0)) < n).all()
        apart = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2))
        assert apart >= (code.shape[1] + 1) // 2 if n <= 6 else apart >= code.shape[1] // 5
    assert language.codewords(1).shape == (1, 0)


def test_margins_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(3)
    model = language.Model(["a", "b", "c", "d"], draw.integers(0, 50, (4, language.FEATURES)))
    texts = ["", None, "é", "ab cd-ef", "word " * 900, "x" * 700, "Ünï cödé, täxt " * 80, "   ", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    whole = model.margins(batch)
    each = [model.margins(pa.RecordBatch.from_arrays([pa.array([t], pa.string())], names=["text"]))[0] for t in texts]
    monkeypatch.setattr(language, "CHUNK", 50)
    for other in (np.array(each), model.margins(batch)):
        assert np.abs(whole - other).max() < 1e-5
    assert not whole[[0, 1, 7]].any()


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 250 and {r.held_out for r in found} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    for lang in ("de", "en", "es", "fr"):
        mine = [r for r in held if r.lang == lang]
        assert sum(r.lang_pred == lang for r in mine) >= 0.97 * len(mine)


def test_predictions_rest_on_text_alone(spark):
    """Other labels, sources and ids of what is asked change no answer; rows come back one for one."""
    docs = documents(spark)
    model = language.learn(docs)
    assert model.langs == ["de", "en", "es", "fr"]
    got = rows(language.predict(docs, model))
    assert len(got) == docs.count()
    other = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("z")).withColumn("doc_id", F.col("doc_id") + 1)
    assert [r[2:] for r in rows(language.predict(other, model).orderBy("doc_id"))] and sorted(map(str, (r[2:] for r in got))) == sorted(map(str, (r[2:] for r in rows(language.predict(other, model)))))
    relabelled = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    assert rows(language.identify(relabelled)) == got
    by_id = {r[0]: r for r in got}
    for doc_id in (90001, 90002, 90005, 90006):
        assert by_id[doc_id][2:4] == ("und", 0.0)
    assert by_id[90007][2] != "und"
    assert rows(language.identify(docs.filter("false"))) == []
    assert {r[2] for r in rows(language.identify(docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
    assert {r[2] for r in rows(language.identify(docs.withColumn("lang", F.lit("qq"))))} == {"und", "qq"}


def test_mixed_text_is_ambiguous(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    mixed = spark.createDataFrame([(1, "the and of que la los"), (2, "the thing of the and the other ing")], "doc_id long, text string")
    scores = {r.doc_id: r for r in language.predict(mixed, model).collect()}
    assert scores[1].score < scores[2].score and not scores[2].ambiguous


def test_sample_is_bounded_and_takes_a_text_once(spark):
    docs = spark.range(3000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, 'aa', 'bb') AS lang", "IF(id < 1500, 'the same text', concat('text ', id)) AS text")
    counts = {r[0]: r[1] for r in language.sample(docs, 100).groupBy("lang").count().collect()}
    assert set(counts) <= {"aa", "bb"} and all(n <= 140 for n in counts.values()) and sum(counts.values()) > 40
    assert language.sample(docs.filter("text = 'the same text'"), 10**6).count() == 2
