"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (runs of letters, lower-cased) and their beginnings of five to eight
letters, which stand for inflected forms; words count up to twelve letters. They are hashed to
``1 << BITS`` buckets. A factorization machine scores a text by linear weights and by a product of
factors for every pair of its terms, so that two terms can mean more together than the sum of both.

Labels go to the tasks in blocks of at most ``BLOCK_LABELS`` ids, sorted, and no text is shuffled to meet its label:
one pass for each block counts all its labelled documents by bucket and label. The ``FEATURES`` buckets that tell
most about the label (G test) are kept; a second pass gathers the counts of those in a sample of about
``most_sample`` labelled ids, of each the first ``ROWS_PER_ID`` different texts, from which the model is learned. Documents
are then scored in one pass without a shuffle. Only the text is an input of a score.

Defined results: a null or empty text gets the score of a text without terms; rows of the labels
without doc_id or label are not used, of several labels for a document the larger counts; without
labels of both kinds (in all rows, or in the sample) the score is the share of toxic ones (0 without any); repeated rows each keep a
row; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import pieces
from tidemark.llm.language import _letters

BITS, BEGINNINGS, LONGEST = 18, (5, 6, 7, 8), 12
#: Expected number of labelled ids that are learned from, different texts of each, kept buckets, size of the factors.
MOST_SAMPLE, ROWS_PER_ID, FEATURES, FACTORS = 12_000, 2, 1500, 8
#: Labels that are broadcast at once (nine bytes each).
BLOCK_LABELS = 4_000_000
#: Documents that a bucket must occur in, learning rate, penalties of weights and factors, passes.
LEAST_DOCS, RATE, DECAY, EPOCHS = 4, 0.1, 2e-4, 12
#: Buckets for the length of a text, in powers of two, after the hashed ones.
LENGTHS = 32
THRESHOLD = 0.7
PIECE_BYTES = 1 << 18


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all terms of all texts; one bucket of every text says how long it is."""
    joined = " ".join(texts) + " "
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64) + 1)
    letter = codes != 32
    letter[ends - 1] = False
    flips = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
    owner, size = np.searchsorted(ends, starts, "right"), stops - starts
    mixed = np.full(len(starts), 1, np.uint64)
    owners, buckets = [], []
    prime, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    live = np.arange(len(starts))
    wide = codes.astype(np.uint64)
    for k in range(LONGEST):
        live = live[size[live] > k]
        value = (mixed[live] ^ wide[starts[live] + k]) * prime
        mixed[live] = value ^ (value >> np.uint64(29))
        if k + 1 in BEGINNINGS:
            longer = live[size[live] > k + 1]
            owners.append(owner[longer])
            buckets.append((mixed[longer] * prime >> shift).astype(np.int64))
    owners.append(owner)
    buckets.append(((mixed ^ np.uint64(0xABCDEF)) * prime >> shift).astype(np.int64))  # the word itself
    words = np.bincount(owner, minlength=len(texts))
    owners.append(np.arange(len(texts)))
    buckets.append((1 << BITS) + np.ceil(np.log2(words + 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def counted(owner: np.ndarray, feature: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) and the value of each: one for the first occurrence, more slowly for further ones."""
    pair, n = np.unique(owner * features + feature, return_counts=True)
    return pair // features, pair % features, np.log2(1.0 + n)


@dataclass
class Machine:
    kept: np.ndarray  # bucket -> feature, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, bucket = terms(texts)
        feature = self.kept[bucket]
        known = feature >= 0
        row, feature, value = counted(owner[known], feature[known].astype(np.int64), max(1, len(self.weights)))
        out = np.full(len(texts), self.bias)
        np.add.at(out, row, self.weights[feature] * value)
        vx = self.factors[feature] * value[:, None]
        total = np.zeros((len(texts), self.factors.shape[1]))
        np.add.at(total, row, vx)
        square = np.zeros(len(texts))
        np.add.at(square, row, (vx * vx).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(out + ((total * total).sum(axis=1) - square) / 2, -500, 500)))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors from (features, values, label) rows, by adaptive gradient steps on the log loss."""
    random = np.random.default_rng(seed)
    bias, weights = 0.0, np.zeros(features)
    factors = random.normal(0, 0.02, (features, FACTORS))
    bias_sum, weight_sum, factor_sum = 1e-3, np.full(features, 1e-3), np.full((features, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            at, x, label = rows[k]
            vx = factors[at] * x[:, None]
            total = vx.sum(axis=0)
            raw = bias + weights[at] @ x + ((total * total).sum() - (vx * vx).sum()) / 2
            wrong = 1 / (1 + np.exp(-np.clip(raw, -500, 500))) - label
            bias_sum += wrong * wrong
            bias -= RATE * wrong / np.sqrt(bias_sum)
            g = wrong * x + DECAY * weights[at]
            weight_sum[at] += g * g
            weights[at] -= RATE * g / np.sqrt(weight_sum[at])
            g = wrong * (x[:, None] * (total - vx)) + DECAY * factors[at]
            factor_sum[at] += g * g
            factors[at] -= RATE * g / np.sqrt(factor_sum[at])
    return bias, weights, factors


def telling(there: np.ndarray, totals: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """The buckets that tell most about the label. ``there[bucket, label]`` documents hold a bucket, of ``totals[label]``."""
    cells = [there[:, 0], there[:, 1], totals[0] - there[:, 0], totals[1] - there[:, 1]]
    everything = totals.sum()
    present = there.sum(axis=1)
    g = np.zeros(len(there))
    for cell, in_row, label in zip(cells, (present, present, everything - present, everything - present), (0, 1, 0, 1), strict=True):
        expected = np.maximum(in_row * totals[label] / max(1, everything), 1e-12)
        g += np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-12) / expected), 0.0)
    g[present < LEAST_DOCS] = 0
    order = np.lexsort((np.arange(len(g)), -g))[:most]
    return np.sort(order[g[order] > 3.0])


@dataclass
class Labels:
    """A block of labels: ids in order, and of each its label, plus two if it is in the sample."""

    ids: np.ndarray
    kinds: np.ndarray

    def of(self, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        """The rows (text, id) with a label, and their kinds."""
        ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(self.ids, ids)
        place[place == len(self.ids)] = 0
        there = (self.ids[place] == ids) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(there)), self.kinds[place[there]]


def _by_label(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, size = held.value, (1 << BITS) + LENGTHS
        there, totals = np.zeros((size, 2), np.int64), np.zeros(2, np.int64)
        for batch in pieces(batches, PIECE_BYTES):
            batch, kinds = labels.of(batch)
            if len(batch):
                owner, bucket = terms(batch.column(0).fill_null("").to_pylist())
                pair = np.unique(owner * size + bucket)
                np.add.at(there, (pair % size, kinds[pair // size] & 1), 1)
                totals += np.bincount(kinds & 1, minlength=2)
        found = np.flatnonzero(there.sum(axis=1))
        names = ["bucket", "clean", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), *(pa.array(np.append(there[found, k], totals[k])) for k in (0, 1))], names)

    return run


def _gather(labelled, held, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, kept = labelled.value, held.value
        for batch in pieces(batches, PIECE_BYTES):
            batch, kinds = labels.of(batch)
            batch, kinds = batch.filter(pa.array(kinds > 1)), kinds[kinds > 1]
            if not len(batch):
                continue
            owner, bucket = terms(batch.column(0).fill_null("").to_pylist())
            feature = kept[bucket]
            row, feature, value = counted(owner[feature >= 0], feature[feature >= 0].astype(np.int64), features)
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            at = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            x = [value[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            columns = [batch.column(1), pa.array((kinds & 1).astype(np.int32)), pa.array(at, pa.binary()), pa.array(x, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "at", "x"])

    return run


def held_out() -> Column:
    """crc32 of the doc_id as text leaves remainder 1 modulo 3. Null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def label_blocks(labels: DataFrame, most_sample: int, block_labels: int) -> Iterator[Labels]:
    """The labels (id, toxic) without those that are held out, in blocks by a hash of the id."""
    usable = labels.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    total = usable.count()
    grain = 1 << 24
    share = min(grain, -(-grain * most_sample // max(1, total)))
    kinds = F.col("label") + F.when(F.pmod(F.xxhash64("id"), F.lit(grain)) < share, 2).otherwise(0)
    count = -(-total // block_labels)
    part = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(max(1, count)))
    for block in range(count):
        found = usable.filter(part == block).select("id", kinds.cast("byte").alias("kind")).toArrow()  # about block_labels rows
        ids, kind = found.column("id").to_numpy(), found.column("kind").to_numpy()
        order = np.argsort(ids, kind="stable")
        yield Labels(ids[order], kind[order])


def train(documents: DataFrame, labels: DataFrame, most_sample: int = MOST_SAMPLE, block_labels: int = BLOCK_LABELS) -> Machine | float:
    """A machine from documents (doc_id, text) and labels (doc_id, toxic), without held-out rows.

    The share of toxic labels instead, if there are none of one kind.
    """
    context = documents.sparkSession.sparkContext
    whole = isinstance(documents.schema["doc_id"].dataType, T.IntegralType) and isinstance(labels.schema["doc_id"].dataType, T.IntegralType)
    own = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string")))
    usable = labels.filter(~held_out()).dropna(subset=["doc_id", "toxic"]).select(own.alias("id"), "toxic")
    texts = documents.select(F.col("text").cast("string").alias("text"), own.alias("id"))
    size = (1 << BITS) + LENGTHS
    there, totals = np.zeros((size, 2), np.int64), np.zeros(2, np.int64)
    held = [context.broadcast(block) for block in label_blocks(usable, most_sample, block_labels)]
    for block in held:
        counts = texts.mapInArrow(_by_label(block), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic"))
        for bucket, clean, toxic in counts.collect():  # one row per bucket at most
            if bucket < 0:
                totals += (clean, toxic)
            else:
                there[bucket] += (clean, toxic)
    if not totals.all():
        return float(totals[1] / max(1, totals.sum()))
    chosen = telling(there, totals)
    kept = np.full(size, -1, np.int16)
    kept[chosen] = np.arange(len(chosen))
    of_bucket = context.broadcast(kept)
    examples = []
    few = Window.partitionBy("id").orderBy("at", "x")
    for block in held:
        gathered = texts.mapInArrow(_gather(block, of_bucket, max(1, len(chosen))), "id long, label int, at binary, x binary").distinct()
        vectors = gathered.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= ROWS_PER_ID).drop("n")
        examples += [tuple(r) for r in vectors.drop("id").collect()]  # ROWS_PER_ID of the sample's ids at most, a few dozen numbers each
        block.unpersist()
    examples = [(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), label) for label, at, x in sorted(examples)]
    if len({label for *_, label in examples}) < 2:
        return float(totals[1] / totals.sum())
    return Machine(kept, *learn(examples, max(1, len(chosen))))


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for batch in pieces(batches, PIECE_BYTES):
            scores = machine.scores(batch.column(0).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "score"])

    return run


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_sample: int = MOST_SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is at least ``threshold``)."""
    machine = train(documents, labels, most_sample)
    rows = documents.select(F.col("text").cast("string").alias("text"), "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    if isinstance(machine, Machine):
        schema = T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType())])
        scored = rows.mapInArrow(_score(documents.sparkSession.sparkContext.broadcast(machine)), schema)
    else:
        scored = rows.select("doc_id", "held_out", F.lit(machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
