"""Language identification by error-correcting output codes.

Each learned language has a codeword; one binary classifier per bit of it tells the languages whose bit is 1
from the others. Classifiers are linear in the counts of hashed byte n-grams (1 to 3 bytes of lower-cased
letters): a feature's weight is the log-odds of its smoothed rates on either side, in which
every language counts alike. A text's margin on a bit is its mean weight, and its loss against a codeword is
the sum of exp(-margin * bit) over the bits, each weighted by how often that classifier was right on that language
(loss-weighted decoding, with rows of weights that sum to 1). The least loss names the language; where the
runner-up is as good as equal the text is flagged as ambiguous.

What is fitted is bounded: SAMPLE_TEXTS distinct texts a language, and FEATURES weights a bit. Everything
else reads whole texts of all documents in one scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, int64s, mix, slices, spaced, text_bytes, written

#: Distinct texts of each language that classifiers are fitted on and weighed by (about; by hash of the text),
#: and the share of them that only weigh.
SAMPLE_TEXTS, WEIGHED = 4000, 0.25
#: Hashed n-grams; smoothing added to each count; the scale at which a margin counts as 1.
FEATURE_BITS, SMOOTHING, SCALE = 15, 0.5, 0.4
FEATURES = 1 << FEATURE_BITS
#: Below this difference of the two best languages' probabilities a text is ambiguous.
AMBIGUOUS = 0.1
UNDETERMINED = "und"
LETTER = r"\p{L}"

#: Bytes inside of words: ASCII letters and all bytes beyond ASCII.
_INSIDE = np.array([97 <= b <= 122 or b >= 128 for b in LOWER])
_CODE, _NONE = np.where(_INSIDE, LOWER, 32).astype(np.uint32), np.uint32(0xFFFFFFFF)
#: Bytes that are looked at together.
CHUNK = 1 << 16


# ---------------------------------------------------------------- codes


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language. Up to six languages: every division into two (all pairs of rows differ
    in half of the bits); more: the code with the largest least distance of 32 that a hash draws, of
    ten bits for each doubling of the languages."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        split = np.arange(1, 1 << (languages - 1))
        return np.where((split >> np.arange(languages)[:, None]) & 1, -1.0, 1.0)
    bits, best = 10 * int(np.ceil(np.log2(languages))), (-1, None)
    for seed in range(32):
        drawn = mix(np.arange(languages * bits, dtype=np.uint64) + np.uint64(seed << 32)) & np.uint64(1)
        code = np.where(drawn.reshape(languages, bits) == 1, 1.0, -1.0)
        code = code[:, np.abs(code.sum(0)) < languages]  # a bit that all languages share tells nothing
        apart = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(languages), 2))
        if apart > best[0]:
            best = (apart, code)
    return best[1]


# ---------------------------------------------------------------- n-grams


def _grams(data: np.ndarray) -> np.ndarray:
    """Features of the 1-, 2- and 3-gram that end at each byte; FEATURES if it doesn't lie in a word and the spaces
    around it. All other bytes count as spaces."""
    inside, code = _INSIDE[data], _CODE[data]
    features = np.full((3, len(data)), _NONE, np.uint32)
    np.copyto(features[0], code, where=inside)
    two = code[:-1] << np.uint32(8) | code[1:]
    np.copyto(features[1, 1:], two | np.uint32(1 << 24), where=inside[:-1] | inside[1:])
    np.copyto(features[2, 2:], two[:-1] << np.uint32(8) | code[2:] | np.uint32(1 << 25), where=inside[1:-1])
    hashed = (features * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)
    hashed[features == _NONE] = FEATURES
    return hashed.astype(np.int64)


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes and where each row starts in them, of pieces of about CHUNK bytes: many rows with a space around each, or
    a part of a longer row. The last number says how many bytes were in the part before."""
    for low, high in slices(at, CHUNK):
        if at[high] - at[low] <= CHUNK:
            buffer, starts = spaced(data, at, low, high)
            starts = starts[:-1] + 1  # the space before the first row is its own
            starts[:1] = 0
            yield low, np.concatenate(([32], buffer)).astype(np.uint8), starts, 0
            continue
        whole = np.concatenate(([32], data[at[low] : at[high]], [32])).astype(np.uint8)
        for start in range(0, len(whole), CHUNK):
            again = min(start, 2)
            yield low, whole[start - again : start + CHUNK], np.zeros(1, np.int64), again


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, starts and features of each piece of a batch's texts."""
    for low, buffer, starts, again in _pieces(*text_bytes(batch)):
        features = _grams(buffer)
        features[:, :again] = FEATURES
        yield low, starts, features


# ---------------------------------------------------------------- learning


def held_out() -> Column:
    """Whether the CRC-32 of the id in decimals leaves 1 when divided by 3; a null id is an empty string, and not held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def sample(docs: DataFrame, bound: int = SAMPLE_TEXTS) -> DataFrame:
    """lang, weighs, text: about `bound` distinct texts of each language, by hash of the text, of documents that
    are not held out. Rows of one text count once, however many there are."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out())
    rates = labelled.groupBy("lang").agg((F.lit(float(bound)) / F.count("*")).alias("rate"))
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & ~held_out())
    kept = texts.join(F.broadcast(written(rates, "rates")), "lang").filter(unit < F.col("rate"))  # a row a language
    weighs = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1000)) < int(1000 * WEIGHED)
    return kept.select("lang", "text", weighs.alias("weighs")).dropDuplicates(["lang", "text"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(int64s(batch, "lang").to_pylist(), object)
        for low, starts, features in _counted(batch):
            own = langs[low : low + len(starts)]
            for lang in set(own):
                chosen = features[:, np.repeat(own == lang, np.diff(np.append(starts, features.shape[1])))]
                total = totals.setdefault(lang, np.zeros(FEATURES, np.int64))
                total += np.bincount(chosen.ravel(), minlength=FEATURES + 1)[:FEATURES]
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "feature", "n"])


class Model:
    """Languages, their codewords, a weight for each feature and bit, and for each language and bit the
    loss's weight."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        rate = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
        ones, zeros = self.code > 0, self.code < 0
        weights = [np.log(rate[ones[:, b]].mean(0) / rate[zeros[:, b]].mean(0)) for b in range(self.code.shape[1])]
        # the last row stands for what is no n-gram
        self.weights = np.zeros((FEATURES + 1, self.code.shape[1]), np.float32)
        self.weights[:FEATURES] = np.array(weights).reshape(self.code.shape[1], FEATURES).T
        self.trust = np.full(self.code.shape, 1.0 / max(self.code.shape[1], 1))

    def margins(self, batch: pa.RecordBatch) -> np.ndarray:
        """Mean weight of each text's n-grams on each bit."""
        sums, n = np.zeros((batch.num_rows, self.code.shape[1])), np.zeros(batch.num_rows)
        for low, starts, features in _counted(batch):
            each = np.take(self.weights, features[0], axis=0)
            for more in features[1:]:
                each += np.take(self.weights, more, axis=0)
            sums[low : low + len(starts)] += np.add.reduceat(each, starts, axis=0)
            n[low : low + len(starts)] += np.add.reduceat((features < FEATURES).sum(0), starts)
        return sums / np.maximum(n, 1)[:, None]

    def weigh(self, right: np.ndarray, n: np.ndarray) -> None:
        """The loss's weights: how often each classifier was right on each language; rows sum to 1."""
        shares = (right + 1.0) / (n + 2.0)
        self.trust = shares / shares.sum(1, keepdims=True)

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: losses through a softmax."""
        z = np.clip(margins / SCALE, -8, 8)
        loss = (self.trust[None] * np.exp(-z[:, None, :] * self.code[None])).sum(2)
        best = np.exp(loss.min(1, keepdims=True) - loss)
        return best / best.sum(1, keepdims=True)


def learn(docs: DataFrame, bound: int = SAMPLE_TEXTS) -> Model:
    """The model of the documents that are not held out; without languages if none has a label and a letter.

    What reaches the driver is a number for each language and feature, and one for each language and bit.
    """
    texts = written(sample(docs, bound), "sample")
    counted = texts.filter("NOT weighs").select("lang", "text").mapInArrow(_count, "lang string, feature int, n long")
    counts = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(r.lang for r in texts.select("lang").distinct().collect())
    table = np.zeros((len(langs), FEATURES))
    table[counts["lang"].map({name: k for k, name in enumerate(langs)}).to_numpy(int), counts["feature"].to_numpy(int)] = counts["n"]
    model = Model(langs, table)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(shared.value.langs)}
        for batch in batches:
            own = np.array([place[name] for name in int64s(batch, "lang").to_pylist()], np.int64)
            hits = (shared.value.margins(batch) * shared.value.code[own] > 0).astype(np.int64)
            who, bit = np.repeat(own, hits.shape[1]), np.tile(np.arange(hits.shape[1]), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(bit), pa.array(hits.ravel())], names=["lang", "bit", "hit"])

    judged = texts.filter("weighs").select("lang", "text").mapInArrow(right, "lang long, bit long, hit long")
    hits, n = np.zeros(model.code.shape), np.zeros(model.code.shape)
    for lang, bit, hit, all_ in judged.groupBy("lang", "bit").agg(F.sum("hit"), F.count("*")).collect():
        hits[lang, bit], n[lang, bit] = hit, all_
    model.weigh(hits, n)
    shared.destroy()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row.

    docs: doc_id, text; other columns are ignored. lang_pred is a learned language, or `und` with score 0
    where the text is null or has no letter, or where no language was learned. score: the best language's
    probability. ambiguous: it leads by less than AMBIGUOUS. Equal texts get equal answers; of equally good
    languages the first by name is taken. Rows with null ids or repeated rows are answered each; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lettered = int64s(batch, "lettered").to_numpy(zero_copy_only=False).astype(bool)
            pred, score, unsure = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if known.langs and lettered.any():
                chances = known.decode(known.margins(batch))
                best = chances.argmax(1)
                top = np.take_along_axis(chances, best[:, None], 1)[:, 0]
                np.put_along_axis(chances, best[:, None], 0.0, 1)
                pred[lettered] = np.array(known.langs, object)[best[lettered]]
                score[lettered] = top[lettered]
                unsure = lettered & (top - chances.max(1) < AMBIGUOUS) & (len(known.langs) > 1)
            columns = [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered")
    )
    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """predict() of all documents by what learn() finds in those that are not held out."""
    return predict(docs, learn(docs))
