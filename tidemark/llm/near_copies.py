"""Near-duplicates: wide SimHash fingerprints compared bit-sliced, decided by Jaccard similarity.

A text is the set of its shingles of five words, lower-cased. Texts of equal words are first folded to
one row. A fingerprint has ``64 * LIMBS`` bits, one per random projection of the set. Two texts of Jaccard
similarity s differ in a share of acos(2 s / (1 + s)) / pi of the bits: 38.8 of 256 at 0.8, with a standard
deviation of 5.7, so ``RADIUS`` is three deviations away from that. No ranges of bits are equal often enough at such a
radius, so buckets come from ``BANDS`` groups of ``WIDTH`` minimum hashes (0.992 of the pairs at 0.8 meet). Inside
a bucket the fingerprints lie side by side as bit planes, and the carry-save kernel of ``simhash`` compares
64 members at a time. Members without another one within the radius go; the rest falls into units, the
components of the radius in a bucket. Units with the same members are folded to one, and only then do
texts travel: once for each of their different units. A unit passes on a spanning forest of the pairs
that reach the Jaccard similarity ``least``.

A bucket of more than ``CHUNK`` members is dealt in chunks at random. Chunks of different buckets overlap, so
large groups of copies become one component in this first round. A second round looks for links
between chunks: buckets whose members all have one component are done; of the others, members of the
component with the most members are compared with the rest, and the rest with itself.

Defined results: texts without words are copies of each other; a text of fewer than five words is one
shingle; repeated rows, null ids and other columns as in ``simhash.keep_one``; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import spans
from tidemark.llm.graph import components
from tidemark.llm.simhash import near, row_key, rows_of
from tidemark.session import staged

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, WIDTH = 12, 5
LIMBS, RADIUS = 4, 56
#: Texts, and bytes of text, of a bucket that one task compares with each other (twice as many where two chunks meet).
CHUNK, CHUNK_BYTES = 2048, 1 << 23
#: Members gathered for a run of the kernel, and (fingerprint, word) comparisons held at a time.
GATHER, SLICE = 1 << 15, 1 << 15


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    places = zip([0, *ends[: len(words) - size]], ends[size - 1 :], strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s : e - 1], seed) for s, e in places), np.uint64))


def _keys(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray, width: int) -> list[int]:
    """One bucket key for each band of ``width`` minimum hashes."""
    low = hashes.astype(np.uint32)[:, None]
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(least, (low[at : at + 256] * factors + offsets).min(axis=0), out=least)
    raw, step = least.tobytes(), 4 * width
    return [xxhash.xxh64_intdigest(raw[k : k + step], k) for k in range(0, len(raw), step)]


def wide_fingerprint(hashes: np.ndarray, limbs: int = LIMBS) -> np.ndarray:
    """Bit b is set if it is set in more than half of the shingles' hashes; every limb mixes the hashes anew."""
    out = np.zeros(limbs, np.uint64)
    for limb in range(limbs):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            mixed = (hashes[at : at + (1 << 14)] ^ np.uint64(0x9E3779B97F4A7C15 * (limb + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[limb] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _sketches(shingle: int, seed: int, bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(seed)
        factors = random.integers(0, 1 << 31, bands * width, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        offsets = random.integers(0, 1 << 32, bands * width, dtype=np.uint32)
        for batch in batches:
            names, sizes, codes, keys = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                words = _words(text.as_py() or "")
                names.append(xxhash.xxh64_intdigest(b" ".join(words), seed))
                sizes.append(sum(map(len, words)) + len(words))
                hashes = shingles(words, shingle, seed)
                codes.append(wide_fingerprint(hashes).astype("<u8").tobytes())
                keys += _keys(hashes, factors, offsets, width)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * bands, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            made = [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), buckets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "fp", "size", "code", "buckets"])

    return run


def _limbs(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each limb, a column for each fingerprint."""
    return np.ascontiguousarray(np.frombuffer(b"".join(codes.to_pylist()), "<u8").reshape(len(codes), -1).T)


def neighbours(codes: np.ndarray, unit: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a unit within the radius whose labels differ, as the groups that they connect.

    Members are sorted by unit. Returns for each the first member of its group, and whether it has a pair.
    """
    limbs, count = codes.shape
    new = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    ends = np.repeat(np.append(new[1:], count), np.diff(np.append(new, count)))
    width = -(-count // 64)
    bits = np.zeros((width * 64, 64 * limbs), np.uint8)
    bits[:count] = np.unpackbits(np.ascontiguousarray(codes.T).view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    first_word, last_word = (np.arange(count) + 1) // 64, (ends - 1) // 64
    todo = np.where(np.arange(count) + 1 < ends, last_word - first_word + 1, 0)
    bounds = np.searchsorted(np.cumsum(todo), np.arange(SLICE, int(todo.sum()) + SLICE, SLICE), "left") + 1
    root, paired, full, begin = np.arange(count), np.zeros(count, bool), ~np.uint64(0), 0
    labels = np.pad(label, (0, width * 64 - count), mode="edge").reshape(width, 64)
    label_low, label_high = labels.min(axis=1), labels.max(axis=1)
    for stop in np.unique(np.minimum(bounds, count)).tolist():
        rows = np.arange(begin, stop)
        begin = stop
        member, word = np.repeat(rows, todo[rows]), spans(first_word[rows], todo[rows])
        groups = np.pad(root, (0, width * 64 - count), mode="edge").reshape(width, 64)
        settled = (groups.min(axis=1)[word] == root[member]) & (groups.max(axis=1)[word] == root[member])
        settled |= (label_low[word] == label[member]) & (label_high[word] == label[member])
        member, word = member[~settled], word[~settled]
        if not len(member):
            continue
        low = np.clip(member + 1 - 64 * word, 0, 63).astype(np.uint64)
        high = np.clip(64 * (word + 1) - ends[member], 0, 63).astype(np.uint64)
        which, alive = near(planes, codes[:, member], word, (full << low) & (full >> high), radius)
        at, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left, right = member[which[at]], 64 * word[which[at]] + lane
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        paired[left] = paired[right] = True
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(deeper := root[root], root):
                root = deeper
    return root, paired


def by_unit(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by the column ``unit`` in tables of whole units, of ``most`` rows or one unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= most:
            table = pa.Table.from_batches(held)
            unit = table.column("unit").to_numpy()
            whole = int(np.searchsorted(unit, unit[-1], "left"))  # the last unit may go on
            if whole:
                yield table.slice(0, whole).combine_chunks()
            held = table.slice(whole).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _group(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_unit(batches, GATHER):  # unit, fp, label, code
            unit, fp, label = (table.column(name).to_numpy() for name in ("unit", "fp", "label"))
            root, paired = neighbours(_limbs(table.column("code")), unit, label, radius)
            at = np.flatnonzero(paired)
            yield pa.RecordBatch.from_arrays([pa.array(unit[at]), pa.array(fp[root[at]]), pa.array(fp[at])], ["unit", "first", "fp"])

    return run


def _grouped(members: DataFrame, radius: int) -> DataFrame:
    """(unit, fp): the groups inside the units of ``members`` (unit, fp, label, code), of equal groups one."""
    dealt = members.repartition("unit").sortWithinPartitions("unit")
    found = dealt.mapInArrow(_group(radius), "unit long, first long, fp long")
    found = staged(found.select(F.xxhash64("unit", "first").alias("unit"), "fp"), "groups")
    sign = [F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.bit_xor(F.xxhash64("fp")).alias("mix")]
    same = found.groupBy("unit").agg(*sign).groupBy("n", "low", "mix").agg(F.min("unit").alias("unit"))
    return found.join(same.select("unit"), "unit")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b) or len(a) / len(b) < least:
        return not len(b)
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared) >= least


def spanning(sets: list[np.ndarray], codes: np.ndarray, label: np.ndarray, least: float, radius: int) -> list[tuple[int, int]]:
    """Links of similar sets within the radius that connect all such pairs. Equal labels are connected already."""
    _, root = np.unique(label, return_inverse=True)
    found = []
    for k in range(1, len(sets)):
        distance = np.bitwise_count(codes[:, :k] ^ codes[:, k : k + 1]).sum(axis=0, dtype=np.int64)
        close = np.flatnonzero((distance <= radius) & (root[:k] != root[k]))
        close = close[np.argsort(distance[close], kind="stable")]
        while len(close):
            j, close = close[0], close[1:]
            if similar(sets[k], sets[j], least):
                found.append((k, int(j)))
                root[root == root[j]] = root[k]
                close = close[root[close] != root[k]]
    return found


def _verify(shingle: int, seed: int, least: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, sets = None, [], []

        def linked() -> pa.RecordBatch:
            codes = _limbs(pa.array([code for *_, code in held], pa.binary()))
            pairs = spanning(sets, codes, np.array([label for _, label, _ in held]), least, radius)
            return pa.RecordBatch.from_arrays([pa.array([held[p[side]][0] for p in pairs], pa.int64()) for side in (0, 1)], ["u", "v"])

        for batch in batches:  # unit, fp, label, code, text; sorted by unit
            for now, fp, label, code, text in zip(*batch.columns, strict=True):
                if now.as_py() != unit:
                    if len(held) > 1:
                        yield linked()
                    unit, held, sets = now.as_py(), [], []
                held.append((fp.as_py(), label.as_py(), code.as_py()))
                sets.append(shingles(_words(text.as_py() or ""), shingle, seed))
        if len(held) > 1:
            yield linked()

    return run


def _similar(documents: DataFrame, members: DataFrame, groups: DataFrame, shingle: int, seed: int, least: float, radius: int) -> DataFrame:
    """(u, v) links of similar texts of a group. ``members`` (fp, key, check, code, label) tells where the texts are."""
    asked = groups.select("fp").distinct()
    places = members.join(asked, "fp").select("fp", "key", "check", "code", "label")
    text = F.col("text").cast("string")
    held = documents.select(*row_key(text), text.alias("text")).join(places, ["key", "check"])
    one = Window.partitionBy("fp").orderBy("fp")  # repeated rows, cut to one per task before the shuffle
    held = held.withColumn("n", F.row_number().over(one)).filter("n = 1").select("fp", "label", "code", "text")
    units = groups.join(held, "fp").select("unit", "fp", "label", "code", "text")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(shingle, seed, least, radius), "u long, v long")


def _chunks(n: Column, size: Column, chunk: int) -> Column:
    return F.greatest(F.ceil(n / chunk), F.ceil(size / CHUNK_BYTES)).cast("long")


def first_round(keyed: DataFrame, chunk: int) -> DataFrame:
    """(unit, fp): the members of buckets with company, each in one chunk of its bucket."""
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1")
    dealt = keyed.drop("size").join(sizes.select("bucket", _chunks(F.col("n"), F.col("size"), chunk).alias("chunks")), "bucket")
    return dealt.select(F.xxhash64("bucket", F.pmod(F.xxhash64("fp", "bucket"), "chunks")).alias("unit"), "fp")


def second_round(keyed: DataFrame, chunk: int) -> DataFrame:
    """(unit, fp): members of different components (``label``) of buckets that were dealt in chunks.

    The members of the largest component of a bucket meet all others, and the others meet each other.
    """
    n, size = F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    parts = keyed.groupBy("bucket", "label").agg(n, size)
    whole = parts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("big"), F.count(F.lit(1)).alias("labels")
    )
    chunks = whole.filter(F.col("labels") > 1).filter(_chunks(F.col("n"), F.col("size"), chunk) > 1).select(
        "bucket",
        F.col("big.label").alias("big"),
        _chunks(F.col("big.n"), F.col("big.size"), chunk).alias("of_big"),
        _chunks(F.col("n") - F.col("big.n"), F.col("size") - F.col("big.size"), chunk).alias("of_rest"),
    )
    dealt = keyed.drop("size").join(chunks, "bucket").withColumn("at_big", F.col("label") == F.col("big"))
    own = F.pmod(F.xxhash64("fp", "bucket"), F.when(F.col("at_big"), F.col("of_big")).otherwise(F.col("of_rest")))
    upto = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    side = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("at"))
    meets = F.when(F.col("at_big"), F.transform(upto("of_rest"), side("rest"))).otherwise(
        F.concat(F.transform(upto("of_big"), side("big")), F.transform(upto("of_rest"), side("rest")))
    )
    met = dealt.select("bucket", "fp", "at_big", own.alias("own"), F.explode(meets).alias("other"))
    among = (F.col("other.kind") == "rest") & ~F.col("at_big")
    of_rest, of_big = (F.when(F.col("at_big"), a).otherwise(b) for a, b in ((F.col("other.at"), F.col("own")), (F.col("own"), F.col("other.at"))))
    across = F.xxhash64("bucket", F.lit("across"), of_rest, of_big)
    inside = F.xxhash64("bucket", F.lit("inside"), F.least("own", "other.at"), F.greatest("own", "other.at"))
    return met.select(F.when(among, inside).otherwise(across).alias("unit"), "fp")


def keep_one(
    documents: DataFrame,
    shingle: int = SHINGLE,
    least: float = LEAST,
    radius: int = RADIUS,
    bands: int = BANDS,
    width: int = WIDTH,
    seed: int = SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """The documents, all columns, of which one row stays per component of near-duplicates: that of the smallest doc_id."""
    text = F.col("text").cast("string")
    source = documents.select("doc_id", *row_key(text), text.alias("text"))
    added = T.StructType.fromDDL("fp long, size long, code binary, buckets array<long>").fields
    rows = source.mapInArrow(_sketches(shingle, seed, bands, width), T.StructType([*source.schema.fields[:-1], *added]))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "check")
    firsts = [F.first(c).alias(c) for c in ("size", "code", "buckets")]
    distinct = staged(rows.groupBy("fp").agg(F.min(order).alias("least"), *firsts), "distinct")
    keyed = distinct.select("fp", "size", F.explode("buckets").alias("bucket"))
    members = distinct.select("fp", "least.key", "least.check", "code", F.col("fp").alias("label"))
    deal = lambda units, members: units.join(members.select("fp", "label", "code"), "fp")
    groups = _grouped(deal(first_round(keyed, chunk), members), radius)
    links = staged(_similar(documents, members, groups, shingle, seed, least, radius), "links")
    roots = staged(components(links), "roots").withColumnRenamed("u", "fp")
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    if crowded.filter(_chunks(F.col("n"), F.col("size"), chunk) > 1).filter("n > 1").limit(1).count():
        labelled = members.drop("label").join(roots, "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
        labelled = staged(labelled, "labelled")
        units = second_round(keyed.join(labelled.select("fp", "label"), "fp"), chunk)
        groups = _grouped(deal(units, labelled), radius)
        more = _similar(documents, labelled, groups, shingle, seed, least, radius)
        links = staged(links.unionByName(more), "links")
        roots = staged(components(links), "roots").withColumnRenamed("u", "fp")
    member = distinct.join(roots, "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = member.groupBy("root").agg(F.min("least").alias("first")).select("first.key", "first.check").distinct()
    return rows_of(documents, kept)
