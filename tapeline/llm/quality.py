"""A ledger of quality rules, with DataFrame functions only.

Every rule is evaluated once: the ledger keeps the measurements and one bit for each rule that a
document fails. A policy is a named mask of bits, so that changing or comparing policies never
reads a text again. Ablations count, by bitwise sums over the ledger, what a rule alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, written

WINDOW = 5
#: Bit of each rule, in this order; rules are only ever added at the end, so stored ledgers stay valid.
RULES = (
    "few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "many_words", "stop_words", "bullets", "ellipses",
    "digits", "capitals", "braces", "boilerplate", "unended_lines", "vocabulary", "short_lines", "broken_chars",
)
#: Versioned policies: the rules that reject. v3 suits any language, v3_en needs English stop words too.
POLICIES = {
    "v1": RULES[:2],
    "v2": RULES[:5],
    "v3": tuple(r for r in RULES if r != "stop_words"),
    "v3_en": RULES,
}
#: Fixed values.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
BULLETS = ("-", "*", "•", "‣", "●")
ENDS = (".", "!", "?", '"', "”")
BOILERPLATE = ("lorem ipsum", "javascript", "privacy policy")


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(rule) for rule in rules)


def mask(policy: str) -> int:
    return mask_of(POLICIES[policy])


def words_of(text: Column) -> Column:
    """Maximal runs of anything but space and \\t to \\r; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more in the list."""

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        )

    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"])

        return F.sort_array(let(pairs, same))

    def covered(p: Column) -> Column:
        gap = lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, k: acc + gap(k))

    def counted(h: Column) -> Column:
        # most texts repeat nothing, which a hash set tells without a sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes(w), counted)))


def measure(docs: DataFrame) -> DataFrame:
    """docs with the struct `m` of measurements; one pass over the text, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))

    without = lambda chars: F.length(text) - F.length(F.replace(text, F.lit(chars)))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    def lines(all_lines: Column) -> Column:
        bare = F.transform(all_lines, lambda x: F.btrim(x, F.lit(SPACES)))
        count = lambda test: F.size(F.filter(bare, test))
        return F.struct(
            F.size(all_lines).alias("n"), (F.size(all_lines) - F.size(F.array_distinct(all_lines))).alias("dup"),
            count(lambda x: F.left(x, F.lit(1)).isin(*BULLETS)).alias("bullet"), count(lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…"))).alias("ellipsis"),
            count(lambda x: F.right(x, F.lit(1)).isin(*ENDS)).alias("ended"),
        )

    def of(w: Column) -> Column:
        stops = F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS))))
        return F.struct(
            F.size(w).alias("n"), repeated_words(w).alias("repeat"), F.size(F.array_distinct(w)).alias("distinct"), stops.alias("stop")
        )

    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    parts = docs.withColumn("q_words", let(words_of(F.col("text")), of)).withColumn("q_lines", let(with_word, lines))
    phrases = let(F.lower(text), lambda t: sum((F.contains(t, F.lit(p)).cast("int") for p in BOILERPLATE), F.lit(0)))
    found = {
        "n_words": F.col("q_words.n"), "word_chars": F.length(text) - gone(SPACES), "n_symbols": gone("#*$%&|<>"), "n_dup_lines": F.col("q_lines.dup"),
        "n_repeat_words": F.col("q_words.repeat"), "n_lines": F.col("q_lines.n"), "n_distinct_words": F.col("q_words.distinct"),
        "n_stop_words": F.col("q_words.stop"), "n_bullet_lines": F.col("q_lines.bullet"), "n_ellipsis_lines": F.col("q_lines.ellipsis"),
        "n_ended_lines": F.col("q_lines.ended"), "n_digits": only("0-9"), "n_capitals": only("A-Z"), "n_braces": without("{") + without("}"),
        "n_boilerplate": phrases, "n_broken": without("\ufffd"),
    }
    return parts.withColumn("m", F.struct(*[c.cast("long").alias(k) for k, c in found.items()])).drop("q_words", "q_lines")


def failures(m: Column, rules: tuple[str, ...] = RULES) -> Column:
    """The bits of the given rules that measurements fail."""
    n, lines = m["n_words"], m["n_lines"]
    tests = {
        "few_words": n < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * n,
        # a symbol for every four words or more: marks on every word, or cells of a table
        "symbols": 4 * m["n_symbols"] > n,
        "duplicate_lines": (m["n_dup_lines"] >= 5) & (2 * m["n_dup_lines"] > m["n_lines"]),
        "word_length": (n > 0) & ((m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n)),
        "many_words": n > 100_000,
        "stop_words": m["n_stop_words"] < 2,
        "bullets": 10 * m["n_bullet_lines"] > 9 * lines,
        "ellipses": 10 * m["n_ellipsis_lines"] > 3 * lines,
        "digits": 5 * m["n_digits"] > m["word_chars"],
        "capitals": 10 * m["n_capitals"] > 3 * m["word_chars"],
        "braces": 20 * m["n_braces"] > n,
        "boilerplate": m["n_boilerplate"] > 0,
        "unended_lines": 10 * m["n_ended_lines"] < lines,
        # long texts say the same words again, so the demand stops at 100 words
        "vocabulary": 10 * m["n_distinct_words"] < F.least(n, F.lit(1000)),
        "short_lines": n < 2 * lines,
        "broken_chars": 100 * m["n_broken"] > m["word_chars"],
    }
    bits = F.lit(0)
    for bit, rule in enumerate(RULES):
        if rule in rules:
            bits = bits + F.when(tests[rule], F.lit(1 << bit)).otherwise(F.lit(0))
    return bits.cast("int")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: one bit for each rule of RULES that the text fails.

    docs: doc_id, text; other columns are ignored. A null text is empty: no words, so it fails
    few_words. A null id stays null. Repeated rows have a row each; an empty table gives none.
    """
    # cut to two columns before anything is added, so that no other name can clash
    return measure(docs.select("doc_id", "text")).select("doc_id", "m.*", failures(F.col("m")).alias("failed"))


def stored(docs: DataFrame) -> DataFrame:
    """ledger(docs) as a table in the shared folder: policies and ablations read it, not the texts."""
    return written(ledger(docs), "ledger")


def verdicts(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger's entries with base_failed (v1) and kept (the policy named)."""
    hits = lambda name: F.col("failed").bitwiseAND(F.lit(mask(name))) != 0
    return entries.withColumn("base_failed", hits("v1")).withColumn("kept", ~hits("v1") & ~hits(policy))


def ablation(entries: DataFrame) -> DataFrame:
    """policy, rule, n_failed (documents that fail it) and n_only (those that fail nothing else of the
    policy, so that it alone decides), of every policy, from one table of bit patterns."""
    rows = entries.groupBy("failed").agg(F.count("*").alias("n"))  # at most 2**rules rows
    rules = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).alias("mask"), F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit"))
        for p, names in POLICIES.items() for r in names
    ])
    rows = rows.select("failed", "n", F.explode(rules).alias("r"))
    inside = F.col("failed").bitwiseAND(F.col("r.mask"))
    return rows.groupBy("r.policy", "r.rule").agg(
        F.sum(F.when(inside.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(inside == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def reject(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that a policy and v1 keep, with their own columns; no shuffle.

    Whole rows pass by with their entry, so ids may repeat or be null; rules outside of the policy are
    not tested. A null text is empty and fails few_words; each repeated row is judged
    by itself; an empty table stays empty; columns may have any names.
    """
    own, row = docs.columns, F.struct("*")
    entries = measure(docs.select(row.alias("q_row"), "text"))
    bits = failures(F.col("m"), POLICIES[policy] + POLICIES["v1"])
    return entries.filter(bits == 0).select(*[F.col("q_row").getField(c).alias(c) for c in own])
