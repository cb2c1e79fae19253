"""Benchmark decontamination with suffix arrays over the training words.

Each piece of a documents partition is a shard. A shard's word suffixes are sorted into a suffix
array; every suffix of the benchmark is then searched in it by binary search, one word deeper per
round, which gives the longest verbatim match and all its places. A match as long as a window marks
its words as hit.

The benchmark is the query set. It goes to the tasks in blocks of a bounded number of words, and
the documents flow through one pass for each block; nothing else is broadcast and no document is
shuffled.

Defined results: a null or empty text has no words and is clean; a benchmark item without words
matches nothing; repeated rows each keep a row of their own; a null item id is written as ``null``;
empty tables give empty or clean results. Other columns of the documents, of whatever name, pass
through ``remove_contaminated`` untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import lists, pieces, spans, text_column, utf8
from tidemark.session import staged

#: Fixed: what counts as a word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Words of a benchmark block (about 60 bytes each in a task), and of a segment of one item.
BLOCK_WORDS, SEGMENT_WORDS = 500_000, 2_000
#: Bytes of text in a shard, and bytes hashed at a time.
SHARD_BYTES, HASH_BYTES = 4 << 20, 1 << 19

_PRIME = 0x9E3779B97F4A7C15


@functools.cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word, and a random number for it, the same for A and a."""
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    inside = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    numbers = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return inside, numbers[lower]


@functools.lru_cache(maxsize=1)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.full(count, _PRIME, np.uint64).cumprod()])
    down = np.concatenate([one, np.full(count, pow(_PRIME, -1, 1 << 64), np.uint64).cumprod()])
    return up, down


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, in order, and the index of each text's first word."""
    inside, numbers = _byte_tables()
    member = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], member[:-1]]) & ~edge[:-1]
    after = np.concatenate([member[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # words of about HASH_BYTES at a time; a longer word goes alone
        after_last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")))
        low, high = starts[first], ends[after_last - 1]
        size = 1 << max(int(HASH_BYTES - 1).bit_length(), int(high - low).bit_length())
        up, down = _powers(size)
        sums = np.concatenate([np.zeros(1, np.uint64), (numbers[raw[low:high]] * up[: high - low]).cumsum()])
        s, e = starts[first:after_last] - low, ends[first:after_last] - low
        hashes[first:after_last] = (sums[e] - sums[s]) * down[s]
        first = after_last
    return hashes, np.searchsorted(starts, offsets)


def suffix_array(words: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """The positions sorted by the words that follow, compared over at most ``depth`` words.

    ``words`` holds at least ``depth`` + 1 zeros at its end. Four words are compared per round, and
    only positions that are still tied go on.
    """
    order = positions.copy()
    open_at = np.arange(len(order))  # slots of the array whose order is not final
    group = np.zeros(len(order), np.int64)
    for level in range(0, depth, 4):
        if not len(open_at):
            break
        at = order[open_at] + level
        high = words[at].astype(np.int64) << 32 | words[at + 1]
        low = words[at + 2].astype(np.int64) << 32 | words[at + 3]
        rank = np.lexsort((low, high, group))
        order[open_at] = order[open_at][rank]
        group, high, low = group[rank], high[rank], low[rank]
        new = np.ones(len(rank) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        tied = ~(new[:-1] & new[1:]) & (low & 0xFFFFFFFF > 0)  # a zero ends every comparison
        group = np.cumsum(new[:-1])[tied]
        open_at = open_at[tied]
    return order


@dataclass
class Block:
    """Benchmark words as numbers from 1 on; segments follow each other with a zero between."""

    vocabulary: np.ndarray  # sorted hashes; word number = place + 1
    tokens: np.ndarray
    need: np.ndarray  # length of the window that starts at a token, 0 if none does
    item: np.ndarray  # index of the token's item
    origin: np.ndarray  # place of the token in its item
    names: list[str]
    least: np.ndarray  # by word number: the shortest window that starts with it

    @property
    def depth(self) -> int:
        return SEGMENT_WORDS + WINDOW


def encode_block(rows: list, window: int) -> Block:
    """A block from rows (item, start, words, whole)."""
    texts = [" ".join(r["words"]) for r in rows]
    raw, offsets = utf8(pa.array(texts, pa.string()))
    hashes, first = word_hashes(raw, offsets)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    sizes = np.diff(first)
    total = len(hashes) + len(rows)
    tokens, need = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
    item, origin = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
    names = sorted({r["item"] for r in rows})
    index = {name: k for k, name in enumerate(names)}
    at = 0
    for k, row in enumerate(rows):
        n = int(sizes[k])
        tokens[at : at + n] = number[first[k] : first[k + 1]] + 1
        item[at : at + n] = index[row["item"]]
        origin[at : at + n] = row["start"] + np.arange(n)
        if row["whole"] and n < window:
            need[at] = n
        else:
            need[at : at + max(0, n - window + 1)] = window
        at += n + 1
    least = np.full(len(vocabulary) + 1, np.iinfo(np.int64).max)
    starts = np.flatnonzero(need)
    np.minimum.at(least, tokens[starts], need[starts])
    return Block(vocabulary, tokens, need, item, origin, names, least)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks. Long items are cut into segments that overlap by window - 1 words."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"),
    ).filter(F.size("words") > 0)
    step = SEGMENT_WORDS - window + 1
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = words.select(
        "item", "words", (F.size("words") < window).alias("whole"), F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start")
    ).select("item", "start", "whole", F.slice("words", F.col("start") + 1, SEGMENT_WORDS).alias("words"))
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // block_words)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("item", "start"), F.lit(max(1, count))))
    for part in range(count):
        rows = dealt.filter(F.col("part") == part).orderBy("item", "start").collect()  # about block_words words
        if rows:
            yield encode_block(rows, window)


def shard_words(batch: pa.RecordBatch, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the shard, 0 for words outside the benchmark and after each text; first index of each text."""
    raw, offsets = utf8(text_column(batch))
    hashes, first = word_hashes(raw, offsets)
    place = np.searchsorted(block.vocabulary, hashes)
    place[place == len(block.vocabulary)] = 0
    number = np.where(block.vocabulary[place] == hashes, place + 1, 0)
    sizes = np.diff(first)
    begin = first + np.arange(len(first))
    words = np.zeros(len(number) + len(sizes) + block.depth + 8, np.int64)
    words[np.arange(len(number)) + np.repeat(np.arange(len(sizes)), sizes)] = number
    return words, begin


def search(words: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Binary search of every benchmark suffix in the shard's suffix array.

    Yields per round (suffixes, low, high, array, length): array[low:high] are the places where the
    first ``length`` words of the suffix stand. Only places where a window can start are in the array.
    """
    zero = np.flatnonzero(words == 0)
    live = np.flatnonzero(words)
    run = zero[np.searchsorted(zero, live)] - live
    array = suffix_array(words, live[run >= block.least[words[live]]], block.depth)
    suffix = np.flatnonzero(block.need) if len(array) else np.zeros(0, np.int64)
    low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(array))
    length = 0
    while len(suffix):
        target = block.tokens[suffix + length]
        low, high = _bound(words, array, low, high, length, target), _bound(words, array, low, high, length, target + 1)
        keep = (low < high) & (target > 0)
        suffix, low, high = suffix[keep], low[keep], high[keep]
        length += 1
        if len(suffix):
            yield suffix, low, high, array, length


def _bound(words: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, target: np.ndarray) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = words[array[middle] + length] < target[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def occurrences(words: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and items of all window occurrences in the shard."""
    at, size, item = [], [], []
    for suffix, low, high, array, length in search(words, block):
        full = block.need[suffix] == length
        count = (high - low)[full]
        at.append(array[spans(low[full], count)])
        size.append(np.full(int(count.sum()), length))
        item.append(np.repeat(block.item[suffix[full]], count))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *at]), np.concatenate([empty, *size]), np.concatenate([empty, *item])


def _mark(held, first_pass: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        names = pa.array(block.names, pa.string())
        for batch in pieces(batches, SHARD_BYTES):
            words, begin = shard_words(batch, block)
            at, size, item = occurrences(words, block)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            hit = np.cumsum(change)[:-1] > 0
            flips = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            starts, ends = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
            run_offsets = np.searchsorted(starts, begin)
            row = np.searchsorted(begin, starts, "right") - 1
            pair = np.unique((np.searchsorted(begin, at, "right") - 1) * len(block.names) + item)
            item_offsets = np.searchsorted(pair, np.arange(len(batch) + 1) * len(block.names))
            found = [
                pa.array(np.diff(begin) - 1, pa.int64()),
                lists(run_offsets, starts - begin[row]),
                lists(run_offsets, ends - begin[row]),
                lists(item_offsets, names.take(pa.array(pair % len(block.names)))),
            ]
            if not first_pass:  # add to what earlier blocks have found
                for k in (1, 2, 3):
                    both = pa.concat_arrays([batch.column(2 + k).cast(found[k].type), found[k]])
                    n = len(batch)
                    order = np.arange(2 * n).reshape(2, n).T.ravel()
                    taken = both.take(pa.array(order))
                    found[k] = pa.ListArray.from_arrays(taken.offsets.take(pa.array(np.arange(0, 2 * n + 1, 2))), taken.flatten())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "text", "n_words", "starts", "ends", "items"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, SHARD_BYTES):
        _, first = word_hashes(*utf8(batch.column(1)))
        none = np.zeros(len(batch) + 1, np.int64)
        empty = np.zeros(0, np.int64)
        found = [pa.array(np.diff(first), pa.int64()), lists(none, empty), lists(none, empty), lists(none, pa.array([], pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "text", "n_words", "starts", "ends", "items"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document (doc_id, text): n_words, hit runs [starts, ends) in words, and the items found.

    Runs and items of several blocks follow each other and can overlap; see ``summary``.
    """
    context = documents.sparkSession.sparkContext
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType())]
    fields += [T.StructField(name, T.ArrayType(kind)) for name, kind in (("starts", T.LongType()), ("ends", T.LongType()), ("items", T.StringType()))]
    schema = T.StructType(fields)
    out = None
    for block in blocks(benchmark, window, block_words):
        held = context.broadcast(block)  # bounded by block_words
        out = source.mapInArrow(_mark(held, True), schema) if out is None else staged(out, "contamination").mapInArrow(_mark(held, False), schema)
    return source.mapInArrow(_count_words, schema) if out is None else out


def summary(marked: DataFrame) -> DataFrame:
    """n_hit (distinct hit words), n_items, the digest of the sorted item ids and the verdict."""
    runs = F.array_sort(F.arrays_zip("starts", "ends"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        runs,
        start,
        lambda a, r: F.struct(
            (a["n"] + F.greatest(r["ends"] - F.greatest(r["starts"], a["upto"]), F.lit(0))).alias("n"),
            F.greatest(a["upto"], r["ends"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct("items"))
    n_hit = F.when(F.size("starts") > 0, covered).otherwise(F.lit(0).cast("long"))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def _keep_clean(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in pieces(batches, SHARD_BYTES):
            words, begin = shard_words(batch, block)
            clean = np.ones(len(batch), bool)
            clean[np.searchsorted(begin, occurrences(words, block)[0], "right") - 1] = False
            yield batch.filter(pa.array(clean))

    return run


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, without those that hold a window of any benchmark item."""
    context = documents.sparkSession.sparkContext
    out = documents
    for k, block in enumerate(blocks(benchmark, window, block_words)):
        held = context.broadcast(block)
        out = (staged(out, "clean") if k else out).mapInArrow(_keep_clean(held), out.schema)
    return out


def _longest(held, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = held.value, TaskContext.get().partitionId() << 33
        names = ["item_id", "item_word", "doc_id", "doc_word", "n_words", "row"]
        for batch in pieces(batches, SHARD_BYTES):
            words, begin = shard_words(batch, block)
            best: dict[int, tuple] = {}
            for suffix, low, high, array, length in search(words, block):
                if length >= window or (block.need[suffix] == length).any():
                    for t, a, b in zip(suffix.tolist(), low.tolist(), high.tolist(), strict=True):
                        if length >= block.need[t]:
                            best[t] = (length, array[a:b])
            rows = []
            for t, (length, places) in best.items():
                row = np.searchsorted(begin, places, "right") - 1
                for p, r in zip(places.tolist(), row.tolist(), strict=True):
                    rows.append((block.names[block.item[t]], int(block.origin[t]), batch.column(0)[r].as_py(), p - int(begin[r]), length, seen + r))
            seen += len(batch)
            kinds = [pa.string(), pa.int64(), batch.schema.field(0).type, *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return run


def _joined(found: DataFrame) -> DataFrame:
    """Matches of a document that continue each other, on the same diagonal of item and document, as one."""
    diagonal = ["item_id", "doc_id", "row", F.col("doc_word") - F.col("item_word")]
    order = Window.partitionBy(*diagonal).orderBy("item_word", "n_words")
    end = F.max(F.col("item_word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("new", F.coalesce(F.col("item_word") > end, F.lit(True)).cast("long"))
    parts = new.withColumn("part", F.sum("new").over(order))
    size = (F.max(F.col("item_word") + F.col("n_words")) - F.min("item_word")).alias("n_words")
    joined = parts.groupBy("item_id", "doc_id", "row", (F.col("doc_word") - F.col("item_word")).alias("diagonal"), "part")
    return joined.agg(F.min("item_word").alias("item_word"), F.min("doc_word").alias("doc_word"), size)


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per benchmark item its longest verbatim match of at least a window, with all places of that length.

    Long items are searched in segments; matches that go on in the next one are joined, so a match of any length is whole.
    """
    context = documents.sparkSession.sparkContext
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    fields = [T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_id", source.schema["doc_id"].dataType)]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in ("doc_word", "n_words", "row")])
    found = None
    for block in blocks(benchmark, window, block_words):
        part = source.mapInArrow(_longest(context.broadcast(block), window), schema)
        found = part if found is None else found.unionByName(part)
    names = [name for name in schema.names if name != "row"]
    if found is None:
        return documents.sparkSession.createDataFrame([], schema).select(*names)
    found = staged(_joined(found), "matches")
    best = found.groupBy("item_id").agg(F.max("n_words").alias("n_words"))
    return found.join(best, ["item_id", "n_words"]).select(*names)
