"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Characters are lower-cased, every run of non-letters becomes one space, and n-grams of one to three
characters are hashed to ``1 << BITS`` features. A feature's value is its share of the text's n-grams
times its inverse document frequency, which is counted over all learnable documents. The weights are
learned by follow-the-regularised-leader with elastic-net penalties, so most stay at zero and only the
others are kept, from a sample; a fifth of the sample sets the temperature that calibrates the scores. Documents
then go through one pass without a shuffle.

The sample: rows of equal text and language count once, and each language gives those of its texts with
the smallest hashes, ``per_language`` of them or, with many languages, its part of ``most_sample``. The
``MOST_LANGUAGES`` values of lang with the most rows are learned.

Only the text is an input of a prediction. Defined results: null texts and texts without a letter
are ``und`` with score 0; a null doc_id is neither held out nor learned from; without learnable
documents all are ``und``; repeated rows each keep a row; an empty table gives an empty one. Other
columns are not read, and pass through ``keep_identified`` untouched.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import pieces, spans, text_column
from tidemark.session import staged

BITS, ORDERS = 16, (1, 2, 3)
#: Different texts of each language in the training sample, the most it may have in all, and the languages learned.
PER_LANGUAGE, MOST_SAMPLE, MOST_LANGUAGES = 800, 20_000, 128
PARTS = 64
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.01, 4
SCALE = 20.0
UNKNOWN = "und"
PIECE_BYTES = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all n-grams of all texts, the first index of each text, and whether it has a letter."""
    joined = " " + " ".join(texts) + "  "
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes  # of the text; the space before it belongs to it
    letter = codes != 32
    keep = letter | np.concatenate([[False], letter[:-1]])
    keep[begin - 1] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    codes = codes[keep].astype(np.uint64)
    first, last = at[begin - 1], at[begin + sizes]  # [first, last) and one more space
    parts, counts = [], []
    primes = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    padded = np.concatenate([codes, np.full(4, 32, np.uint64)])
    for order in ORDERS:
        mixed = np.full(len(codes), order, np.uint64)
        for k in range(order):
            mixed = (mixed ^ padded[k : k + len(codes)]) * primes[k]
        parts.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        counts.append(np.maximum(last - first + 2 - order, 0))  # n-grams end at the space after the text
    starts = [spans(first, c) for c in counts]
    total = sum(counts)
    offsets = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(int(offsets[-1]), np.int64)
    put = offsets[:-1].copy()
    for part, start, count in zip(parts, starts, counts, strict=True):
        out[spans(put, count)] = part[np.minimum(start, len(part) - 1)]
        put += count
    letters = np.concatenate([[0], np.cumsum(letter)])
    return out, offsets, letters[begin + sizes] > letters[begin]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in text_column(batch).to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(1 << BITS, np.int64), 0
    there = np.zeros(1 << BITS, bool)
    for batch in pieces(batches, PIECE_BYTES):
        features, offsets, _ = ngrams(_texts(batch))
        for k in range(len(batch)):
            there[features[offsets[k] : offsets[k + 1]]] = True
            found = np.flatnonzero(there)
            seen[found] += 1
            there[found] = False
        rows += len(batch)
    found = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["feature", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([rows])], ["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang, hash -> the distinct features and their counts, as bytes; once in a task for each lang and hash."""
    seen: set[tuple] = set()
    for batch in pieces(batches, PIECE_BYTES):
        fresh = [pair not in seen and not seen.add(pair) for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        if not len(batch):
            continue
        features, offsets, lettered = ngrams(_texts(batch))
        index, count = [], []
        for k in range(len(batch)):
            own = features[offsets[k] : offsets[k + 1]] if lettered[k] else features[:0]
            found, n = np.unique(own, return_counts=True)
            index.append(found.astype("<u4").tobytes())
            count.append(n.astype("<f4").tobytes())
        columns = [batch.column(1), batch.column(2), pa.array(index, pa.binary()), pa.array(count, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "hash", "features", "counts"])


@dataclass
class Model:
    languages: list[str]
    features: list[np.ndarray]  # of each language: the features with a weight
    weights: list[np.ndarray]  # and their weights, the inverse document frequency included
    bias: np.ndarray
    temperature: float = 1.0

    @classmethod
    def of(cls, languages: list[str], weights: np.ndarray, bias: np.ndarray) -> Model:
        """From weights by feature and language."""
        kept = [np.flatnonzero(column) for column in weights.T]
        return cls(languages, [k.astype(np.uint32) for k in kept], [weights[k, j] for j, k in enumerate(kept)], bias)

    def logits(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, from the features of its n-grams; one language at a time, so memory does not grow with them."""
        count = np.diff(offsets)
        sums = np.zeros((len(count), len(self.languages)))
        some = count > 0
        if some.any():
            dense = np.zeros(1 << BITS)
            for language, (kept, weights) in enumerate(zip(self.features, self.weights, strict=True)):
                dense[kept] = weights
                sums[some, language] = np.add.reduceat(dense[features], offsets[:-1][some])
                dense[kept] = 0.0
        return SCALE * sums / np.maximum(count, 1)[:, None] + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (features, values, language) rows. The bias is not penalised."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, languages)), np.zeros((size + 1, languages))

    def solve(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, L1)[:, None]
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            features, values, language = rows[k]
            at, x = np.append(features, size), np.append(values, 1.0)
            w = solve(at)
            wrong = softmax(x @ w)
            wrong[language] -= 1.0
            g = x[:, None] * wrong
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    everything = solve(np.arange(size + 1))
    return everything[:-1], everything[-1]


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(logits / math.exp(log_t))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = math.log(0.2), math.log(10.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return math.exp((low + high) / 2)


def held_out() -> Column:
    """crc32 of the doc_id as text leaves no remainder modulo 5. Null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, hash) of the texts that are learned from: of each language the ``per_language`` smallest hashes."""
    found = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    for group in (["lang", F.pmod("hash", F.lit(PARTS))], ["lang"]):  # parts first, so a language is not one task
        order = Window.partitionBy(*group).orderBy("hash")
        found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).drop("n")
    return found


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, most_sample: int = MOST_SAMPLE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model from all rows of (text, lang); None if there is no language to learn."""
    rows = documents.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in counts.collect())
    if not languages:
        return None
    inverse = np.zeros(1 << BITS)
    total = 0
    parts = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for feature, n in parts.collect():  # one row per feature at most
        if feature < 0:
            total = n
        else:
            inverse[feature] = n
    inverse = np.where(inverse > 0, np.log((1 + total) / (1 + inverse)) + 1, 0.0)

    known = rows.filter(F.col("lang").isin(languages))
    few = staged(sampled(known, max(1, min(per_language, most_sample // len(languages)))), "sample")
    hashed = known.withColumn("hash", F.xxhash64("text")).join(F.broadcast(few), ["lang", "hash"])  # most_sample rows at most
    vectors = hashed.select("text", "lang", "hash").mapInArrow(_vectors, "lang string, hash long, features binary, counts binary").distinct()
    learn, tune = [], []
    for lang, own, features, counts in sorted(tuple(r) for r in vectors.collect()):  # most_sample rows at most
        index, values = np.frombuffer(features, "<u4").astype(np.int64), np.frombuffer(counts, "<f4").astype(float)
        if len(index):
            row = (index, SCALE * values / values.sum() * inverse[index], languages.index(lang))
            (tune if own % 5 == 0 else learn).append(row)
    learn = learn or tune
    weights, bias = follow_the_leader(learn, len(languages))
    model = Model.of(languages, weights * inverse[:, None], bias)
    if tune:
        logits = np.array([x @ weights[index] + bias for index, x, _ in tune])
        model.temperature = calibrate(logits, np.array([language for *_, language in tune]))
    return model


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in pieces(batches, PIECE_BYTES):
            features, offsets, lettered = ngrams(_texts(batch))
            chance = softmax(model.logits(features, offsets) / model.temperature)
            best = np.where(lettered, chance.argmax(axis=1), len(model.languages))
            score = np.where(lettered, chance.max(axis=1), 0.0)
            first = 0 if pa.types.is_struct(batch.column(0).type) else 1
            found = [pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *found], [*batch.schema.names[first:], "lang_pred", "score"])

    return run


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` with lang_pred and score. First comes either a text, which is dropped, or a row that has one."""
    kept = [c for c in rows.columns if c != "text"]
    if model is None:
        return rows.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    fields = [*[rows.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(_predict(rows.sparkSession.sparkContext.broadcast(model)), T.StructType(fields))


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents (doc_id, text, lang)."""
    model = train(documents.filter(~held_out()).select("text", "lang"), per_language)
    rows = documents.select(F.col("text").cast("string").alias("text"), "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return predict(rows, model)


def keep_identified(documents: DataFrame, least_score: float = 0.5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents, all columns, whose language is known with at least this score."""
    model = train(documents.filter(~held_out()).select("text", "lang"), per_language)
    row = F.struct(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns])
    found = predict(documents.select(row.alias("row")), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
