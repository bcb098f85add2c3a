"""Personal data and the terms that disclose it, with DataFrame functions only.

The base rules find e-mail addresses, IP addresses, card and phone numbers: the protected entities.
A term discloses an entity if seeing the term tells who is meant. The evidence is counted by contexts,
the words within REACH characters of an entity on its line, and copies are one: texts that are equal
count once in all, and contexts of one entity whose words are much the same make one class. n(t, e) is
the number of classes of the entity's contexts that have the term, n(e) of all its classes, and n(t)
is n(t, e) and the number of distinct texts that have the term but not near the entity. Over N distinct
texts the term's disclosure is the pointwise mutual information log2(n(t, e) * N / (n(t) * n(e))) in
bits, with the conditional probability n(t, e) / n(t). Terms at or over both thresholds, near the
entity in at least `support` classes and as many texts, are spans too, wherever they stand: a sentence says nothing of
its words, however often it was copied.

Contexts are alike by MinHash: one class holds all that share one of BANDS bands of ROWS hashes of
their word sets, directly or through others. Word sets of Jaccard 0.7 meet with a probability of
0.998, of 0.5 with 0.88, of 0.2 with 0.12.

An entity has the words of REACH characters on either side at most, so that no line, however long,
pairs all its entities with all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, discard, let, written
from .components import components
from .spans import listed, marked, matches, none, outside

KINDS = ("email", "ip", "card", "phone", "term")
# Fixed patterns of the base rules; groups repeat possessively, and where an e-mail can't begin,
# \G or no such character before, saves trying every tail of a long word.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Everything but the characters of terms.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM_CHARS = r"0-9a-z\x{80}-\x{10FFFF}"
#: Thresholds of disclosure: bits, probability, classes of contexts; characters of a term, and around an entity.
BITS, SHARE, SUPPORT, TERM_LENGTH, REACH = 6.0, 0.8, 2, 3, 200
#: Bands of a context's sketch, and hashes of a band.
BANDS, ROWS = 16, 3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = lambda c: F.aggregate(F.transform(c, lambda x, i: value(x, i, F.size(c))), F.lit(0), lambda a, v: a + v)
    return let(F.split(digits, ""), total) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Spans of e-mails, IPs, cards and phones; each test is made only where its sign occurs."""
    bare = lambda x: F.regexp_replace(x["m"], "[^0-9]", "")
    has = lambda sign, spans: F.when(F.contains(text, F.lit(sign)), spans).otherwise(none())
    email = has("@", matches(text, EMAIL))
    ip = F.filter(matches(text, IP), lambda x: F.rlike(x["m"], F.lit(rf"^(?:{BYTE}\.){{3}}{BYTE}$")))
    card = F.filter(matches(text, CARD), lambda x: F.length(bare(x)).between(14, 19))
    card = F.filter(card, lambda x: luhn(bare(x)))
    phone = F.filter(has("+", matches(text, PHONE)), lambda x: F.length(bare(x)).between(10, 15))
    return [email, ip, card, phone]


def contexts(docs: DataFrame, base: list[Column] | None = None) -> DataFrame:
    """document, entity, terms: the words around each protected entity. docs: document, text; base: base_spans of text."""
    lines = docs.select("document", F.explode(F.array_distinct(F.split("text", "\n"))).alias("text"))
    lines = lines.filter(F.rlike("text", F.lit("@|[0-9][0-9\\x20().-]{5}")))
    found = lines.select("document", "text", F.explode(F.concat(*(base or base_spans(F.col("text"))))).alias("x"))
    low = F.greatest(F.col("x.s") - REACH, F.lit(0))
    high = F.least(F.col("x.e") + REACH, F.length("text"))
    words = F.split(ascii_lower(F.substring(F.col("text"), low + 1, high - low)), APART)
    # the words at the cuts may be parts of words
    words = F.slice(words, F.when(low > 0, 2).otherwise(1), F.size(words) - (low > 0).cast("int") - (high < F.length("text")).cast("int"))
    entity = ascii_lower(F.col("x.m"))
    # the words of the entity itself say nothing about it
    terms = F.filter(F.array_except(words, F.split(entity, APART)), lambda t: F.length(t) >= TERM_LENGTH)
    return found.select("document", entity.alias("entity"), terms.alias("terms"))


def terms_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(ascii_lower(text), APART)), lambda t: F.length(t) >= TERM_LENGTH)


def classes(near: DataFrame) -> DataFrame:
    """near (document, entity, terms) with the class of each context: the least hash of the contexts
    that it is alike with. Contexts of equal words are hashed once, so copies cost nothing; a band
    links each of its contexts to its least one, so no pairs are made. A context without words is a
    class of its own with its like."""
    near = near.withColumn("node", F.xxhash64("entity", F.array_sort("terms")))
    sets = near.filter(F.size("terms") > 0).select("node", "entity", F.array_sort("terms").alias("terms")).distinct()
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda i: F.array_min(F.transform("terms", lambda t: F.xxhash64(t, i))))
    sets = sets.select("node", "entity", least.alias("least"))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64("entity", b, F.slice("least", b * ROWS + 1, ROWS)))
    bands = written(sets.select("node", F.explode(band).alias("band")), "bands")
    firsts = bands.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    links = written(bands.join(firsts, "band").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "alike")
    if links.isEmpty():
        discard(bands, links)
        return near.withColumnRenamed("node", "class")
    roots = broadcast_if_small(components(links), F.lit(64))
    discard(bands, links)
    return near.join(roots, "node", "left").select("document", "entity", "terms", F.coalesce("root", "node").alias("class"))


def _share() -> Column:
    return F.col("n_te") / (F.col("n_te") + F.col("n_t") - F.col("texts"))


def disclosing_terms(
    docs: DataFrame, bits: float = BITS, share: float = SHARE, support: int = SUPPORT, base: list[Column] | None = None
) -> DataFrame:
    """term, entity, bits, share of every term at or over the thresholds; docs: doc_id, text.

    Null is an empty text; ids don't matter, and repeated texts are one. An empty table gives none. base: base_spans of text, if made already."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("document"), "text")
    every = written(contexts(rows, base), "contexts")
    # terms of an entity of fewer texts have too few
    again = every.groupBy("entity").agg(F.count_distinct("document").alias("n")).filter(F.col("n") >= support).select("entity")
    near = written(every.join(again, "entity").select("document", "entity", "terms"), "near")
    known = written(classes(near), "classes")
    n_e = known.groupBy("entity").agg(F.count_distinct("class").alias("n_e")).filter(F.col("n_e") >= support)
    each = known.join(n_e, "entity").select("entity", "n_e", "document", "class", F.explode("terms").alias("term"))
    pairs = each.groupBy("term", "entity", "n_e").agg(F.count_distinct("class").alias("n_te"), F.count_distinct("document").alias("texts"))
    pairs = written(pairs.filter(F.least("n_te", "texts") >= support), "pairs")
    # n(t) is no less than the texts with the term near any entity: pairs that fail by these already, as
    # those of common words do, need no count over whole texts
    least = every.select("document", F.explode("terms").alias("term")).join(broadcast_if_small(pairs.select("term"), F.octet_length("term") + 64), "term", "left_semi")
    least = least.groupBy("term").agg(F.count_distinct("document").alias("n_t"))
    open_pairs = written(pairs.join(least, "term").filter(_share() >= share).drop("n_t"), "open")
    # texts are counted by their rows, each for its part, so that no text has to move
    distinct = written(rows.groupBy("document").agg(F.count("*").alias("rows")), "texts")
    n = distinct.count()
    repeated = written(distinct.filter(F.col("rows") > 1), "repeated")
    weight = F.lit(1.0) / F.coalesce("rows", F.lit(1))
    wanted = written(open_pairs.select("term").distinct(), "candidates")
    n_t = rows.join(broadcast_if_small(repeated, F.lit(64)), "document", "left").select(F.explode(terms_of(F.col("text"))).alias("term"), weight.alias("w"))
    n_t = n_t.join(broadcast_if_small(wanted, F.octet_length("term") + 64), "term").groupBy("term").agg(F.round(F.sum("w")).alias("n_t"))
    scored = open_pairs.join(n_t, "term").withColumn("share", _share())
    scored = scored.withColumn("bits", F.log2(F.col("share") * F.lit(n) / F.col("n_e")))
    found = written(scored.filter((F.col("bits") >= bits) & (F.col("share") >= share)).select("term", "entity", "bits", "share"), "disclosing")
    discard(every, near, known, pairs, open_pairs, distinct, repeated, wanted)
    return found


def _scanned(docs: DataFrame, bits: float, share: float, support: int) -> DataFrame:
    """doc_id, text, b (base spans by kind), base and marks of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base_spans(F.col("text"))
    found = disclosing_terms(rows, bits, share, support, base)
    terms = written(found.select("term").distinct(), "terms")
    discard(found)
    terms = broadcast_if_small(terms, F.octet_length("term") + 64)
    # by a hash of the text, which also serves null and repeated ids
    keyed = rows.select(F.xxhash64("text").alias("key"), "text")
    flagged = keyed.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term")
    flagged = written(flagged.distinct().groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms")), "flagged")
    flagged = broadcast_if_small(flagged, F.octet_length(F.array_join("terms", "")) + 64 * (1 + F.size("terms")))
    rows = rows.withColumn("key", F.xxhash64("text")).join(flagged, "key", "left")
    rows = rows.select("doc_id", "text", "terms", F.struct(*[x.alias(k) for k, x in zip(KINDS, base)]).alias("b"))
    bases = F.concat(*[marked(F.col(f"b.{k}"), i) for i, k in enumerate(KINDS[:4])])
    word = lambda t: F.concat(F.lit(f"(?<![{TERM_CHARS}])"), t, F.lit(f"(?![{TERM_CHARS}])"))
    hits = F.flatten(F.transform("terms", lambda t: matches(ascii_lower(F.col("text")), word(t))))
    hits = outside(hits, F.concat(*[F.col(f"b.{k}") for k in KINDS[:4]]))
    added = F.when(F.col("terms").isNull(), none("array<struct<s:int,k:int,e:int>>")).otherwise(marked(hits, 4))
    return rows.select("doc_id", "text", "b", bases.alias("base"), F.concat(bases, added).alias("marks"))


def scan(docs: DataFrame, bits: float = BITS, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """doc_id, counts of base spans, and the marks (start, kind, end) of base and of all spans.

    docs: doc_id, text; other columns are ignored. Null is an empty text. Added spans are whole
    words, never overlap base spans, and are found in every document that has the term. Repeated rows
    have a row each (and count as one document in all statistics); an empty table gives none.
    """
    found = _scanned(docs, bits, share, support)
    return found.select("doc_id", *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]], "base", "marks")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("marks"), KINDS).alias("spans")
    )


def sanitise(docs: DataFrame, bits: float = BITS, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text with base spans generalised to [KIND] and disclosing terms removed as [TERM].

    docs: doc_id, text; other columns are ignored. Each row is rewritten by its own spans, whatever ids
    it shares; of overlapping spans the first counts. Null becomes ''. Rows come out as they went in,
    null and repeated ids too; an empty table gives none.
    """
    rows = _scanned(docs, bits, share, support).select("doc_id", "text", F.sort_array("marks").alias("marks"))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        clean = F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.get(name, x["k"])))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), clean.alias("out")))

    last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.lit(2147483647)))
    return rows.select("doc_id", F.aggregate("marks", start, put, last).alias("text"))
