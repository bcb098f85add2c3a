"""Operators with an SQL or row-wise contract, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as xxh64

from tapeline.llm import decontam, pii, quality, secrets
from tests.llm.cases import KEY, documents, empty, rows, texts


def _listed(marks):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(marks))


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_secret_base_spans(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.digest(secrets.scan(docs)).collect()}
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    want = set()
    for doc, text in texts(docs):
        text, marks, n = text or "", [], Counter()
        for k, (kind, regex) in enumerate((("assign", assign), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
            for m in regex.finditer(text):
                if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                    marks.append((m.start(), k, m.end(), kind))
                    n[kind] += 1
        want.add((doc, _sha(_listed(marks)), n["assign"], n["access"], n["hex"]))
    assert got == want
    assert sum(x[2] for x in want) > 1
    assert rows(secrets.digest(secrets.scan(empty(spark)))) == []


def test_markov_models_tell_keys_from_identifiers(spark):
    random = [hashlib.sha256(str(i).encode()).hexdigest()[:30] for i in range(400)] + [KEY[i:] + KEY[:i] for i in range(8, 30)]
    plain = ["_".join(("get", "user", "record", "from", "cache", "table", "index", "value")[(i * k) % 8] for k in range(1, 5)) for i in range(400)]
    samples = spark.createDataFrame([(t, True) for t in random[::2]] + [(t, False) for t in plain[::2]], "token string, random boolean")
    model = secrets.fit(samples)
    held = spark.createDataFrame([(t, True) for t in random[1::2]] + [(t, False) for t in plain[1::2]], "token string, random boolean")
    judged = held.select("random", secrets.is_random(F.col("token"), secrets.as_column(model)).alias("said")).collect()
    assert sum(r.random == r.said for r in judged) >= 0.97 * len(judged)
    docs = documents(spark).filter("doc_id IN (90015, 90001)")
    found = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs, model)).collect()}
    assert found == {90015: f"random:10:{10 + len(KEY)}", 90001: ""}


def _is_random(token, model):
    codes = [(secrets.ALPHABET + token).index(c) for c in token]
    total = sum(model[a * secrets.SIZE + b] for a, b in zip(codes, codes[1:]))
    return total >= secrets.LEAST and total >= secrets.THRESHOLD * (len(token) - 1)


def test_random_spans(spark):
    """All spans against plain Python, on the documents with planted keys."""
    rng = __import__("random").Random(1)
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) for n in (8, 12, 16, 20, 24, 32, 40, 64) for _ in range(10)]
    lines = [f"the service was given {k} for version2023 of utf8mb4 and nothing else, url=/{k}" for k in keys]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(lines, 70000)), "doc_id long, text string"))
    model = secrets.fit(secrets.labelled(docs, 1 << 20))
    token = re.compile(secrets.TOKEN)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.spans) for r in secrets.digest(secrets.scan(docs, model)).collect())
    want, caught, wrong = [], set(), 0
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    for doc, text in texts(docs):
        text = text or ""
        marks = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        marks += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        marks += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        for m in token.finditer(text):
            if _is_random(m[0], model):
                marks.append((m.start(), 3, m.end(), "random"))
                caught.add(m[0])
                wrong += m[0] in ("version2023", "utf8mb4")
        want.append((doc is not None, doc or 0, _listed(marks)))
    assert got == sorted(want)
    planted = [k for k in keys if re.fullmatch(token, k)]
    assert sum(k in caught for k in planted) >= 0.9 * len(planted) and not wrong


def test_secrets_held_out(spark):
    """Half of the given tables' labelled strings train the models; the other half is judged."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labelled = secrets.labelled(docs, 1 << 20).withColumn("half", F.pmod(F.xxhash64("token"), F.lit(2)))
    labelled.cache()
    model = secrets.fit(labelled.filter("half = 0"))
    judged = labelled.filter("half = 1").groupBy("random", secrets.is_random(F.col("token"), secrets.as_column(model)).alias("said")).count().collect()
    labelled.unpersist()
    n = {(r.random, r.said): r["count"] for r in judged}
    right = n.get((True, True), 0)
    assert right >= 0.9 * (right + n.get((True, False), 0)) and right >= 0.9 * (right + n.get((False, True), 0)) and right > 20


def _luhn(d):
    t = [int(c) for c in d][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(t)) % 10 == 0


def test_ordinary_tokens_with_digits(spark):
    """Dates, versions, file names, standards, order numbers, of words and forms that no sample has, against planted keys: both as the models judge them."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.as_column(secrets.fit(secrets.labelled(docs, 1 << 20)))
    draw = random.Random(7)
    words = "sensor camera invoice customer release kernel driver session ticket parcel flight meeting archive photo scan device module engine router garden".split()
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    plain = (
        "report20241128 2024-11-28T10 20240115T101500Z IMG_20240115_123456 ISO-8859-1 x86_64-linux-gnu covid-19-2021 model_v2_final2023 user12345 order1234567890 "
        "invoice-000123456 rfc2616-section14 mp4-1080p-h264 build-4521-release python3_10_12 version2023 windows10pro chapter12-section4 A4-210x297mm sha256sum base64url "
        "utf8mb4_general_ci http2-push ipv6-only 3rd-party 20th-century win32api"
    ).split()
    for w in words:
        y, m, d, n = draw.randrange(1980, 2030), draw.randrange(1, 13), draw.randrange(1, 29), draw.randrange(10**6)
        plain += [f"{w}-{d:02}{months[m - 1]}{y}", f"{w.upper()}-{n}", f"{w}_v{m}_{d}", f"{w}-{n}", f"{w[:4]}{m}-{w}{d}", f"{y}-{m:02}-{d:02}-{w}", f"DSC{n:06}", f"{w.title()}{y}Report", f"{m:02}{d:02}{y}T{n:06}", f"{w}{n}_old"]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(draw.choice(letters) for _ in range(n)) for n in (8, 12, 16, 20, 24, 32, 40, 64) for _ in range(12)]
    plain, keys = ({t for t in some if re.fullmatch(secrets.TOKEN, t)} for some in (plain, keys))
    sampled = {r.token for r in secrets.labelled(docs, 1 << 20).collect()}
    assert len(plain) >= 200 and not plain & sampled
    tokens = spark.createDataFrame([(t,) for t in sorted(plain | keys)], "t string")
    marked = {r.t for r in tokens.filter(secrets.is_random(F.col("t"), model)).collect()}
    assert len(marked & plain) <= 0.1 * len(plain), sorted(marked & plain)
    assert len(marked & keys) >= 0.9 * len(keys)


def test_labelled_sample(spark):
    """Bounded for any ids; a token with digits is ordinary if it recurs in different surroundings, not in copies of one."""
    same = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('token=', md5(CAST(id AS STRING)), ' ordinary words here') AS text")
    n = secrets.labelled(same, 100).filter("random").count()
    assert 40 < n < 180
    copies = spark.range(500).selectExpr("id AS doc_id", "concat('one line with Qx7ZpLw2Vn8R in it, copy ', id) AS text")
    about = ["see model zz9-plural now", "the zz9-plural thing", "was zz9-plural ever", "no, zz9-plural!"]
    rows = copies.unionByName(spark.createDataFrame(list(enumerate(about, 9000)), "doc_id long, text string"))
    ordinary = {r.token for r in secrets.labelled(rows, 1 << 20).filter("NOT random").collect()}
    assert "zz9-plural" in ordinary and "Qx7ZpLw2Vn8R" not in ordinary


def test_personal_base_spans(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.scan(docs)).collect()}
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    want = set()
    for doc, text in texts(docs):
        marks, n = [], Counter()
        for k, (kind, regex, test) in enumerate(kinds):
            for m in re.finditer(regex, text or ""):
                if test(m[0]):
                    marks.append((m.start(), k, m.end(), kind))
                    n[kind] += 1
        want.add((doc, n["email"], n["ip"], n["card"], n["phone"], _sha(_listed(marks))))
    assert got == want
    assert rows(pii.digest(pii.scan(empty(spark)))) == []


def test_disclosing_terms(spark):
    said = ["Call {} about case number 1", "for refunds {} will answer by noon", "we met {} and two friends in Oslo", "no reply came from {}", "ask {} where old maps are kept", "{} signed off"]
    lines = [(i, said[i].format(f"zorblatt at jane{i % 2}@corp.example.com") + "\nplain words here") for i in range(6)]
    lines += [(100 + i, f"an ordinary text about case and number and call {i}") for i in range(200)] + [(500, "only Zorblatt, and zorblatts, here")]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    terms = {(r.term, r.entity): round(r.share, 3) for r in pii.disclosing_terms(docs, bits=4.0).collect()}
    assert terms == {}  # below the share
    terms = {(r.term, r.entity): round(r.share, 3) for r in pii.disclosing_terms(docs.unionByName(docs), bits=4.0, share=0.4).collect()}
    assert terms == {("zorblatt", "jane0@corp.example.com"): 0.429, ("zorblatt", "jane1@corp.example.com"): 0.429}
    terms = {r.term for r in pii.disclosing_terms(docs, bits=4.0, share=0.4).collect()}
    assert terms == {"zorblatt"}
    spans = {r.doc_id: r.spans for r in pii.digest(pii.scan(docs, bits=4.0, share=0.4)).collect()}
    assert spans[500] == "term:5:13" and spans[0] == "term:5:13,email:17:39" and spans[100] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, bits=4.0, share=0.4).collect()}
    twice = spark.createDataFrame([(1, "write to you@y.example.org"), (1, "or call"), (None, "x@y.example.org a"), (None, None)], "doc_id long, text string")
    assert rows(pii.sanitise(twice)) == [(None, ""), (None, "[EMAIL] a"), (1, "or call"), (1, "write to [EMAIL]")]
    assert clean[500] == "only [TERM], and zorblatts, here" and clean[0].startswith("Call [TERM] at [EMAIL] about case number 1")


def test_copies_disclose_nothing(spark):
    """Words of a text under two ids, of a near copy, or of a line that many documents share, are no terms; those of different
    sentences are. 40 planted names, 40 texts with an entity in five near copies each."""
    rng = __import__("random").Random(5)
    say = lambda n: [f"w{rng.randrange(1500)}x" for _ in range(n)]
    line = lambda words: " ".join(words)
    others = [line(say(40)) for _ in range(300)]
    two = "About the quarterly numbers please contact zebulon harquist before meeting at zeb@mail.example.com"
    shared = "questions about maps and tickets go to our helpdesk team at help@site.example.org"
    docs = others + [two, two] + [line(say(50)) + "\n" + shared for _ in range(30)]
    for p in range(40):  # near copies: two words of a hundred differ
        words = say(50) + [f"only{p}a only{p}b at", f"copy{p}@mail.example.com", f"only{p}c"] + say(50)
        for _ in range(5):
            mine = list(words)
            for k in rng.sample([i for i in range(len(mine)) if not 50 <= i < 53], 2):
                mine[k] = say(1)[0]
            docs.append(line(mine))
        docs += [line(say(20) + [f"ask name{p}y at", f"real{p}@mail.example.com"] + say(20)) for _ in range(3)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    terms = {r.term for r in pii.disclosing_terms(table).collect()}
    names = {f"name{p}y" for p in range(40)}
    assert len(names & terms) >= 0.9 * len(names) and len(names & terms) >= 0.9 * len(terms)
    assert not terms & set(f"{two} {shared}".split()) and not any(t.startswith("only") for t in terms)
    clean = {r.text for r in pii.sanitise(table).collect()}
    assert two.replace("zeb@mail.example.com", "[EMAIL]") in clean
    nulls = spark.createDataFrame([(None, None), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert rows(pii.disclosing_terms(nulls)) == [] and rows(pii.disclosing_terms(empty(spark))) == []


def test_disclosing_spans(spark):
    """Terms and spans against plain Python, and planted names among common words."""
    rng = __import__("random").Random(2)
    common = [f"word{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    planted = [(f"{say(30)} ask name{p}x {say(3)} p{p}@mail.example.com {say(60)}\n{say(5)}") for p in range(30) for _ in range(3)] + [say(60) for _ in range(300)]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(planted, 60000)), "doc_id long, text string"))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    base = lambda t: [m for regex, test in kinds for m in re.finditer(regex, t) if test(m[0])]
    every = {t or "" for _, t in texts(docs)}
    near, of = defaultdict(list), defaultdict(set)  # contexts of each entity; texts of each term
    for t in every:
        for line in t.split("\n"):
            for m in base(line):
                i, j = max(0, m.start() - pii.REACH), min(len(line), m.end() + pii.REACH)
                words = re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(line[i:j]))[i > 0 :]
                words = words[:-1] if j < len(line) else words
                own = re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(m[0]))
                near[low(m[0])].append((frozenset(w for w in words if len(w) >= 3 and w not in own), t))
        for w in word.findall(low(t)):
            of[w].add(t)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    least = lambda c: [min(signed(xxh64(i.to_bytes(4, "little"), xxh64(w.encode(), 42))) for w in c) for i in range(pii.BANDS * pii.ROWS)]
    want = set()
    for e, found in near.items():
        of_context = {c: c for c, _ in found}
        bands = defaultdict(list)
        for c in of_context:
            for k, b in enumerate(zip(*[iter(least(c))] * pii.ROWS)) if c else ():
                bands[k, b].append(c)
        root = lambda c: c if of_context[c] == c else root(of_context[c])  # noqa: E731, B023
        for cs in bands.values():
            for c in cs[1:]:
                of_context[root(c)] = root(cs[0])
        n_e = len({root(c) for c in of_context})
        for w in set().union(*of_context) if n_e >= pii.SUPPORT else ():
            n_te = len({root(c) for c in of_context if w in c})
            beside = len({t for c, t in found if w in c})
            share = n_te / (n_te + len(of[w]) - beside)
            if min(n_te, beside) >= pii.SUPPORT and share >= pii.SHARE and np.log2(share * len(every) / n_e) >= pii.BITS:
                want.add((w, e))
    got = {(r.term, r.entity) for r in pii.disclosing_terms(docs).collect()}
    assert got == want
    terms = {w for w, _ in want}
    names = {f"name{p}x" for p in range(30)}
    assert len(names & terms) >= 27 and len(names & terms) >= 0.9 * len({t for t in terms if t.startswith(("name", "word"))})
    spans = sorted((r.doc_id or 0, r.spans) for r in pii.digest(pii.scan(docs)).collect())
    brute = []
    for d, t in texts(docs):
        t = t or ""
        marks = [(m.start(), k, m.end(), pii.KINDS[k]) for k, (regex, test) in enumerate(kinds) for m in re.finditer(regex, t) if test(m[0])]
        marks += [(m.start(), 4, m.end(), "term") for m in word.finditer(low(t)) if m[0] in terms and not any(s < m.end() and m.start() < e for s, _, e, _ in marks)]
        brute.append((d or 0, _listed(marks)))
    assert spans == sorted(brute)


def test_quality(spark):
    docs = documents(spark)
    got = rows(quality.verdicts(quality.ledger(docs)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for doc, text in texts(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines))
        base = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        more = 4 * symbols > len(w) or (dup >= 5 and 2 * dup > len(lines)) or chars < 2 * len(w) or chars > 20 * len(w)
        want.append((doc, len(w), chars, symbols, dup, len(cover), base, not base and not more))
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else "") for x in r))
    assert rows(quality.ledger(empty(spark))) == []
    kept = quality.reject(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in want)
    entries = quality.stored(docs)
    table = {(r.policy, r.rule): (r.n_failed, r.n_only) for r in quality.ablation(entries).collect()}
    bits = [r.failed for r in entries.collect()]
    for policy, names in quality.POLICIES.items():
        for rule in names:
            own, whole = quality.mask_of((rule,)), quality.mask(policy)
            assert table[policy, rule] == (sum(b & own != 0 for b in bits), sum(b & whole == own for b in bits)), (policy, rule)
    assert table["v1", "few_words"][0] == sum(r[1] < 10 for r in want)


RULE_CASES = {
    "many_words": "a word. " * 60_000, "stop_words": "plain words only here.", "bullets": "- one two\n* three four\n • five six", "ellipses": "so it goes on...\nand on…",
    "digits": "12 34 56 a b.", "capitals": "ALL OF THIS is loud.", "braces": "a {b} c {d}.", "boilerplate": "Enable JavaScript to go on.", "unended_lines": "no end\nnone here",
    "vocabulary": "on and off. " * 40, "short_lines": "a\nb c\nd", "broken_chars": "caf\ufffd is b\ufffdd.",
}


def test_quality_rules_by_themselves(spark):
    clean = "The men have to go with all of that and be home."
    docs = spark.createDataFrame([(0, clean), *enumerate(RULE_CASES.values(), 1)], "doc_id long, text string")
    got = {r.doc_id: r.failed for r in quality.ledger(docs).collect()}
    assert got[0] == 0
    for k, rule in enumerate(RULE_CASES, 1):
        assert got[k] & quality.mask_of((rule,)), rule
    assert [r.text for r in quality.reject(docs, "v3_en").collect()] == [clean]


def test_contamination(spark):
    docs = documents(spark)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(9001, "lazy dog"), (9002, None), (9003, ""), (9004, "passage word1 number"), (9001, "river bank")], "item_id long, text string")
    bench = bench.unionByName(extra).withColumn("n", F.lit(1))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in [(str(r.item_id), r.text) for r in bench.collect()]:
        w = low(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(k) for k in windows}
    want = []
    for doc, text in texts(docs):
        w, hit, items = low(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= own
        want.append((doc, len(w), len(hit), ",".join(sorted(items))))
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    for sizes_ in ({}, {"shard_bytes": 2000, "block_bytes": 3000}):
        found = decontam.contamination(docs, bench, **sizes_)
        got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ",")).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
        spans = found.select("n_hit", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("s")).collect()
        assert all(r.n_hit == r.s for r in spans)
    assert any(r[2] for r in want)
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not (n > 0 and 20 * n >= k) for _, k, n, _ in want)
    assert rows(decontam.contamination(empty(spark), bench)) == []
    assert {r.n_hit for r in decontam.contamination(docs, bench.filter("false")).collect()} == {0}
