"""Secret scans, with DataFrame functions only.

The base rules find assignments, access keys and hex strings. The method judges every token of
letters and digits: two character Markov models, one of random strings and one of ordinary
identifiers, give a token the log-likelihood ratio of its transitions. The models are counted from
labelled samples of the corpus itself: the values that the base rules find are the random strings. The ordinary
ones are identifier-like words outside of base spans; these words with dates, times, versions and counters put to
them by rule (FORMS), so that the model knows how ordinary tokens carry digits; and tokens with digits that recur in RECURRING
different surroundings, which no secret does. A token counts as random if the mean
ratio reaches THRESHOLD and the sum LEAST, so that short tokens have to be clearer.

Tokens are cut at = and /, and are judged inside of base spans too: there the method tells the secret
itself from the text around it. Tokens without both a letter and a digit, or below 8 characters, are
not judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .spans import MARKS, listed, marked, matches, none, outside

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns of the base rules. A match of the last two below its least length holds no longer
# one, so the length stands in the pattern; a short assignment still uses up its text.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens that the models judge: 8 characters of keys or more, with a letter and a digit.
TOKEN = r"(?<![A-Za-z0-9+_-])(?=[A-Za-z+_-]*+[0-9])(?=[0-9+_-]*+[A-Za-z])[A-Za-z0-9+_-]{8,}+"
#: Ordinary words of a sample: without digits, for a word with digits may itself be a secret.
IDENTIFIER = r"(?<![A-Za-z0-9_-])[A-Za-z_-]{8,}+(?![0-9])"
#: Labelled documents that the models are fitted on, about, by hash of id and text; repeated texts count once.
SAMPLE_DOCS = 20_000
#: Surroundings (the characters before) in which a token with digits stands before it counts as ordinary, and their length.
RECURRING, BEFORE = 3, 16
#: Forms of ordinary names with digits; see numbered().
FORMS = 12
#: Least mean log-likelihood ratio per transition and least sum, in nats, of a token reported as random.
THRESHOLD, LEAST = 0.7, 10.0
#: Characters of the models; others count as the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/="
SIZE = len(ALPHABET)
#: Weight of what is expected of a transition, in transitions: any character after a random one, and
#: the sample's own frequency of the second character after an ordinary one. Most that a transition counts.
EXPECTED, MOST = {True: 2.0 * SIZE, False: 0.5 * SIZE}, 4.0


def base_spans(text: Column) -> list[Column]:
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8)
    return [assign, matches(text, ACCESS), matches(text, HEX)]


def codes(token: Column) -> Column:
    """Indices into ALPHABET of a token's characters."""
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    return F.transform(F.split(token, ""), lambda c: F.when(at(c) > 0, at(c) - 1).otherwise(SIZE - 1))


def transitions(token: Column) -> Column:
    """first * SIZE + second of each two neighbouring characters."""
    return let(codes(token), lambda c: F.when(F.size(c) < 2, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i - 1) * SIZE + F.get(c, i))
    ))


def numbered(word: Column) -> Column:
    """The word as it stands in names with digits: two of the usual forms, chosen by its hash, with digits from it."""
    h = F.abs(F.xxhash64(word) % (1 << 40))
    part = lambda shift, n: F.shiftright(h, shift) % n
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year, month, day = (1990 + part(3, 40)).cast("string"), two(1 + part(9, 12)), two(1 + part(13, 28))
    clock, digit, count = F.concat(two(part(18, 24)), two(part(5, 60)), two(part(11, 60))), part(7, 10).cast("string"), part(2, 1_000_000).cast("string")
    low, title, short = F.lower(word), F.initcap(word), F.substring(word, 1, 3)
    date = F.concat(year, month, day)
    forms = F.array(
        F.concat(low, count), F.concat(low, F.lit("_"), date), F.concat(date, F.lit("T"), clock, F.lit("Z")), F.concat(F.lit("v"), digit, F.lit("-"), month, F.lit("-"), low),
        F.concat(F.upper(short), F.lit("_"), date, F.lit("_"), clock), F.concat(F.upper(short), F.lit("-"), F.substring(count, 1, 4), F.lit("-"), digit),
        F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), two(part(18, 24))), F.concat(F.lower(F.substring(word, 1, 4)), digit, F.lit("_"), month, F.lit("-"), low),
        F.concat(title, year), F.concat(low, F.lit("-"), F.lpad(count, 7, "0")), F.concat(F.upper(F.substring(word, 1, 4)), F.lit("-"), year, F.lit("-"), count), F.concat(low, digit, F.lit("_"), low),
    )
    return F.array(F.get(forms, (h % FORMS).cast("int")), F.get(forms, (F.floor(h / FORMS) % FORMS).cast("int")))


def labelled(docs: DataFrame, sample_docs: int) -> DataFrame:
    """token, random: the labelled strings of about sample_docs documents, each once."""
    n = docs.count()
    share = F.lit(min(1.0, sample_docs / max(1, n)) * (1 << 20))
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share).select(text.alias("text")).distinct()
    some = some.select("text", *[x.alias(k) for k, x in zip(KINDS, base_spans(F.col("text")))])
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 1)
    random = F.concat(F.transform("assign", value), F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"]))
    bases = F.concat("assign", "access", "hex")
    plain = F.transform(outside(matches(F.col("text"), IDENTIFIER), bases), lambda x: x["m"])
    # a token with what stands before it, for those that recur
    seen = F.transform(outside(matches(F.col("text"), TOKEN), bases), lambda x: F.struct(x["m"].alias("token"), F.xxhash64(F.substring(F.col("text"), F.greatest(F.lit(1), x["s"] + 1 - BEFORE), F.least(F.lit(BEFORE), x["s"]))).alias("before")))
    tagged = lambda tokens, kind: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("before")))
    met = F.transform(seen, lambda x: F.struct(x["token"].alias("token"), F.lit("met").alias("kind"), x["before"].alias("before")))
    found = some.select(F.explode(F.concat(tagged(random, "random"), tagged(plain, "plain"), met)).alias("x")).select("x.*")
    found = found.groupBy("token", "kind").agg(F.count_distinct("before").alias("places")).filter((F.col("kind") != "met") | (F.col("places") >= RECURRING))
    tokens = F.when(F.col("kind") == "plain", F.concat(F.array("token"), numbered(F.col("token")))).otherwise(F.array("token"))
    return found.select(F.explode(tokens).alias("token"), (F.col("kind") == "random").alias("random")).distinct()


def fit(samples: DataFrame) -> list[float]:
    """SIZE * SIZE log ratios of transition probabilities, random over ordinary, within MOST."""
    counts = samples.select("random", F.explode(transitions(F.col("token"))).alias("t")).groupBy("t", "random").count()
    tally = {tag: [0] * SIZE**2 for tag in (True, False)}
    for t, random, n in counts.collect():  # at most 2 * SIZE**2 rows
        tally[random][t] = n
    every = sum(tally[False]) + 0.5 * SIZE
    expected = {True: [1 / SIZE] * SIZE, False: [(sum(tally[False][b::SIZE]) + 0.5) / every for b in range(SIZE)]}

    def chance(tag: bool, a: int, b: int, row: int) -> float:
        return (tally[tag][a * SIZE + b] + EXPECTED[tag] * expected[tag][b]) / (row + EXPECTED[tag])

    out = []
    for a in range(SIZE):
        rows = {tag: sum(tally[tag][a * SIZE : (a + 1) * SIZE]) for tag in tally}
        out += [math.log(chance(True, a, b, rows[True]) / chance(False, a, b, rows[False])) for b in range(SIZE)]
    return [max(-MOST, min(MOST, x)) for x in out] if any(tally[True]) and any(tally[False]) else [0.0] * SIZE**2


def score(token: Column, model: Column) -> Column:
    """struct<sum, n>: log-likelihood ratios of a token's transitions, and their number."""
    return let(transitions(token), lambda t: F.struct(F.aggregate(t, F.lit(0.0), lambda acc, x: acc + F.get(model, x)).alias("sum"), F.size(t).alias("n")))


def is_random(token: Column, model: Column, threshold: float = THRESHOLD, least: float = LEAST) -> Column:
    return let(score(token, model), lambda x: (x["sum"] >= least) & (x["sum"] >= threshold * x["n"]))


def as_column(model: list[float]) -> Column:
    """The model as one constant."""
    return F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")


def scan(docs: DataFrame, model: list[float] | None = None, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD, least: float = LEAST) -> DataFrame:
    """doc_id, counts of base spans, and the marks (start, kind, end) of base and of all spans.

    docs: doc_id, text; other columns are ignored. Null is an empty text. model: from fit(), by
    default fitted on the documents' own labelled strings; without any the models are flat and add
    nothing. Repeated rows have a row each; an empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    model = model or fit(labelled(docs.select("doc_id", "text"), sample_docs))
    rows = rows.select("doc_id", "text", F.struct(*[x.alias(k) for k, x in zip(KINDS, base_spans(F.col("text")))]).alias("b"), matches(F.col("text"), TOKEN).alias("tokens"))
    bases = F.concat(*[marked(F.col(f"b.{k}"), i) for i, k in enumerate(KINDS[:3])])
    scored = let(as_column(model), lambda m: F.filter("tokens", lambda x: is_random(x["m"], m, threshold, least)))
    added = F.when(F.size("tokens") == 0, none(MARKS)).otherwise(marked(scored, 3))
    return rows.select(
        "doc_id", *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], bases.alias("base"), F.concat(bases, added).alias("marks")
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("marks"), KINDS).alias("spans")
    )
