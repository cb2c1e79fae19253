"""SimHash near-duplicates: fingerprints, links within a Hamming radius, components.

Fingerprints of 64 bits come from one pass over the texts. Equal fingerprints are first folded to
one row. Two that differ in at most ``radius`` bits agree in at least ``parts - radius`` of
``parts`` bit ranges, so every choice of that many ranges makes a table of buckets, and all links
are found inside buckets. In a task the members of many buckets lie side by side as vertical bit
planes, 64 members a word; one fingerprint is compared with 64 members at a time by carry-save
counters, and words are abandoned as soon as all their members exceed the radius. A bucket passes on
the links of a spanning forest only, not its pairs. Large buckets are dealt in chunks, and pairs of
chunks go to different tasks.

Defined results: a null text or one without words has fingerprint zero and is linked like any other;
rows with a null doc_id take part and get their component's smallest doc_id; repeated rows are kept;
an empty table gives an empty one. Other columns are not read; ``keep_one`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import spans
from tidemark.llm.graph import components
from tidemark.session import staged

SHINGLE, SEED, RADIUS, PARTS = 3, 42, 2, 4
#: Members of a bucket that one task compares with each other, rows gathered for a run of the kernel,
#: and (fingerprint, word) comparisons held at a time.
CHUNK, GATHER, SLICE = 8192, 1 << 15, 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    size = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    starts = [0, *ends[: len(words) - size]]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], ends[size - 1 :][at : at + (1 << 16)], strict=False)
        hashes = np.array([hash_of(joined[s : e - 1], seed) for s, e in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", shingle, seed) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(rows: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns of ``rows``, the last of which is a text, with its fingerprint (signed) in its place."""
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints(shingle, seed), schema)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            same = same & counters[level]
        else:
            above |= same & counters[level]
            same = same & ~counters[level]
    return above


def near(planes: np.ndarray, codes: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each comparison (a code, a word of 64 members) the lanes within the radius, out of ``lanes``.

    ``codes`` has a row for every 64 planes, or is one such row. Returns the comparisons with such lanes, and the lanes. Two planes at a time go through a
    carry-save adder into counters of the lanes; a carry out of the top counter is above any radius.
    """
    limbs = np.atleast_2d(codes)
    index, levels = np.arange(len(words)), radius.bit_length()
    dead = ~lanes
    counters = [np.zeros_like(lanes) for _ in range(levels)]
    zero = np.uint64(0)
    for plane in range(0, len(planes), 2):
        limb, bit = limbs[plane >> 6], plane & 63
        a = planes[plane][words] ^ (zero - (limb >> np.uint64(bit) & np.uint64(1)))
        b = planes[plane + 1][words] ^ (zero - (limb >> np.uint64(bit + 1) & np.uint64(1)))
        if levels:
            half = counters[0] ^ a
            carry = (counters[0] & a) | (half & b)
            counters[0] = half ^ b
            for level in range(1, levels):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            dead |= carry
        else:
            dead |= a | b
        if plane % 8 == 6:
            gone = dead | _over(counters, radius) if levels else dead
            keep = gone != ~zero
            if not keep.all():
                index, words, limbs, dead = index[keep], words[keep], limbs[:, keep], dead[keep]
                counters = [c[keep] for c in counters]
                if not len(index):
                    break
    alive = ~(dead | _over(counters, radius)) if levels else ~dead
    found = alive != 0
    return index[found], alive[found]


def bucket_roots(codes: np.ndarray, buckets: np.ndarray, radius: int) -> np.ndarray:
    """For members sorted by bucket, the index of the first member that each is linked to inside its bucket."""
    count = len(codes)
    root = np.arange(count)
    new = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    ends = np.repeat(np.append(new[1:], count), np.diff(np.append(new, count)))
    width = -(-count // 64)
    bits = np.zeros((width * 64, 64), np.uint8)
    bits[:count] = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    first_word, last_word = (np.arange(count) + 1) // 64, (ends - 1) // 64
    todo = np.where(np.arange(count) + 1 < ends, last_word - first_word + 1, 0)
    bounds = np.searchsorted(np.cumsum(todo), np.arange(SLICE, int(todo.sum()) + SLICE, SLICE), "left") + 1
    full, begin = ~np.uint64(0), 0
    for stop in np.unique(np.minimum(bounds, count)).tolist():
        rows = np.arange(begin, stop)
        begin = stop
        member, word = np.repeat(rows, todo[rows]), spans(first_word[rows], todo[rows])
        if not len(member):
            continue
        padded = np.pad(root, (0, width * 64 - count), mode="edge").reshape(width, 64)
        settled = (padded.min(axis=1)[word] == root[member]) & (padded.max(axis=1)[word] == root[member])
        member, word = member[~settled], word[~settled]
        low = np.clip(member + 1 - 64 * word, 0, 63).astype(np.uint64)
        high = np.clip(64 * (word + 1) - ends[member], 0, 63).astype(np.uint64)
        which, alive = near(planes, codes[member], word, (full << low) & (full >> high), radius)
        pairs = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(pairs)
        left, right = member[which[at]], 64 * word[which[at]] + lane
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(deeper := root[root], root):
                root = deeper
    return root


def _link(radius: int):
    def linked(table: pa.Table) -> pa.RecordBatch:
        codes = table.column("fp").to_numpy()
        unit = table.column("unit").to_numpy()
        root = bucket_roots(codes.view(np.uint64), unit, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(codes[moved]), pa.array(codes[root[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by unit
            held.append(batch)
            if sum(map(len, held)) >= GATHER:
                table = pa.Table.from_batches(held)
                unit = table.column("unit").to_numpy()
                whole = int(np.searchsorted(unit, unit[-1], "left"))  # the last unit may go on
                if whole:
                    yield linked(table.slice(0, whole).combine_chunks())
                held = table.slice(whole).to_batches()
        if held:
            yield linked(pa.Table.from_batches(held).combine_chunks())

    return run


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp`` that connect all pairs within the radius."""
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = [sum(((1 << edges[p + 1]) - (1 << edges[p])) for p in chosen) for chosen in combinations(range(parts), parts - radius)]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("long")
    own = F.pmod(F.xxhash64("fp", "bucket"), chunks)
    dealt = keyed.join(sizes, "bucket").select("fp", "bucket", chunks.alias("chunks"), own.alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    units = dealt.select("fp", "bucket", "own", other).select(
        "fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    )
    schema = "u long, v long"
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_link(radius), schema)


def _rooted(rows: DataFrame, least: Column, radius: int, parts: int) -> DataFrame:
    """``rows`` (with fp) and the smallest ``least`` of their component as ``component_id``."""
    distinct = staged(rows.groupBy("fp").agg(F.min(least).alias("least")), "distinct")
    roots = staged(components(links(distinct.select("fp"), radius, parts)), "roots").withColumnRenamed("u", "fp")
    member = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(member.join(smallest, "root").select("fp", "component_id"), "fp")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, parts: int = PARTS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    rows = staged(fingerprints(documents.select("doc_id", F.col("text").cast("string").alias("text")), shingle, seed), "fingerprints")
    return _rooted(rows, F.col("doc_id"), radius, parts).select("doc_id", "fp", "component_id")


def row_key(text: Column) -> list[Column]:
    """What a row is known by: key and check."""
    return [F.xxhash64("doc_id", text).alias("key"), F.crc32(F.coalesce(text, F.lit(""))).alias("check")]


def rows_of(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents, all columns, of the kept keys (key, check); of rows that repeat both, one."""
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *row_key(F.col("text").cast("string")))
    one = Window.partitionBy("key", "check").orderBy("key")  # cut to one per task before the shuffle
    first = inner.withColumn("n", F.row_number().over(one)).filter("n = 1")
    return first.join(kept, ["key", "check"], "left_semi").select("row.*")


def keep_one(documents: DataFrame, radius: int = RADIUS, parts: int = PARTS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The documents, all columns, of which one row stays per component: that of the smallest doc_id.

    A row is known by its doc_id and two hashes of its text. Of rows that repeat both, one stays; rows
    without doc_id stay only where their whole component has none.
    """
    text = F.col("text").cast("string")
    rows = staged(fingerprints(documents.select("doc_id", *row_key(text), text.alias("text")), shingle, seed), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "check")
    return rows_of(documents, _rooted(rows, order, radius, parts).select("component_id.key", "component_id.check").distinct())
