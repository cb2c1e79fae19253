"""Suffix-array dedup of a corpus: bytes covered by a string of ``size`` bytes that stands elsewhere too.

1. Anchors. In every window of ``size`` bytes the leftmost smallest hash of ``KMER`` bytes is the
   window's anchor, which depends on the window's content alone: equal windows have equal anchors at
   equal places. About one byte in eighty is an anchor. Anchors whose hash occurs once in the corpus
   are done with; only numbers have been shuffled so far.
2. Segments. The texts meet the repeated anchors by a join on the row's key. An anchor's segment is
   the bytes of the windows that it is anchor of. Equal segments of a task fold to one class with a
   count before they are shuffled, so groups of copies, however large, shrink before they meet.
3. Suffix order. The classes of one anchor hash come to one task. The suffixes at window starts are
   sorted by prefix doubling over ``size`` bytes, ties in text order. The previous smaller position in
   suffix order, if it shares the full prefix, is the longest previous factor of at least ``size``
   bytes, and the next one a later copy.
4. The verdicts go back over the class to its members, and meet the texts in the same partitioning:
   the texts are shuffled once.

A hash with more than ``most`` anchors is not sent to one task: each window of its classes becomes a
digest of 128 bits, and the digests are counted with partial aggregation instead; its members meet
their verdicts over ``SALTS`` tasks.

Defined results: a null text is empty; texts shorter than ``size`` lose nothing; repeated rows are
documents of their own when all copies go, and one document (both stay) when the first copy is kept;
an empty table gives an empty one. Other columns, of whatever name, pass through ``cut`` untouched.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import pieces, spans, text_column, utf8
from tidemark.session import staged

SIZE, KMER = 200, 32
#: Anchors of one hash that may meet in a task as segments; bytes sorted at a time; bytes hashed at a time.
MOST, BLOCK_BYTES, PIECE_BYTES = 20_000, 1 << 20, 1 << 18
#: Classes that a task folds at a time; tasks over which the members of a hot hash are dealt.
FOLD, SALTS = 50_000, 64

_PRIME, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _tables(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.full(count, _PRIME, np.uint64).cumprod()])
    down = np.concatenate([one, np.full(count, pow(_PRIME, -1, 1 << 64), np.uint64).cumprod()])
    return np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64), up, down


def anchors(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of the anchors of all texts; places count from the first text's start."""
    numbers, up, down = _tables(PIECE_BYTES + size)
    wide = size - KMER + 1  # hashes in a window
    found = []
    for begin in range(0, len(raw) - size + 1, PIECE_BYTES):
        part = raw[begin : begin + PIECE_BYTES + size - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), (numbers[part] * up[: len(part)]).cumsum()])
        hashes = (sums[KMER:] - sums[:-KMER]) * down[: len(sums) - KMER]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
        hashes ^= hashes >> np.uint64(32)
        least = (hashes & ~np.uint64((1 << 20) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: len(hashes) - wide + 1], least[wide - reach : len(hashes) - reach + 1])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.arange(begin, begin + len(place))
        inside = start + size <= offsets[np.searchsorted(offsets, start, "right")]
        start, place = start[inside], place[inside]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(place)) - 1 if len(place) else new
        found.append((hashes[place[new]].view(np.int64), place[new] + begin, start[new], start[last]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors_only(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(*utf8(batch.column(0)), size)[0])], ["h"])

    return run


def _anchors_placed(size: int):
    """A place holds 16 bits of the row's check, 32 of the position and the distances to the first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 22):
            raw, offsets = utf8(batch.column(0))
            h, place, first, last = anchors(raw, offsets, size)
            row = np.searchsorted(offsets, place, "right") - 1
            spot = (place - offsets[row]) << 16 | (place - first) << 8 | (place - last)
            key, check = batch.column(1).to_numpy(zero_copy_only=False)[row], batch.column(2).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(check << 48 | spot)], ["h", "key", "place"])

    return run


def _found(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """(row, h, c, lo, width, hot, segment) of each repeated anchor in rows of row, key, check, spots."""
    texts, spots = text_column(batch), batch.column(3)
    at, values = spots.offsets.to_numpy(), spots.values.to_numpy()
    for k in range(len(batch)):
        raw = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
        for spot in values[at[k] : at[k + 1]].tolist():
            place, back, near = spot >> 16 & 0xFFFFFFFF, spot >> 8 & 0xFF, spot & 0xFF
            piece = raw[place - back : place - near + size]
            h = xxhash.xxh3_64_intdigest(raw[place : place + KMER]) - (1 << 63)
            c = xxhash.xxh3_64_intdigest(piece, back) - (1 << 63)
            yield k, h, c, place - back, back - near + 1, bool(spot >> 48), piece


def _classes(size: int):
    """Equal segments of a task folded: their number, their first member in document order, and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def folded(classes: dict) -> pa.RecordBatch:
            rows = [(h, c, *rest) for (h, c), rest in classes.items()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in zip((0, 1, 4, 5, 2, 6), kinds, strict=False)]
            rank = pa.array([dict(zip(("none", "doc_id", "key", "check", "lo"), r[3], strict=True)) for r in rows], kinds[-1])
            return pa.RecordBatch.from_arrays([*columns, rank], ["h", "c", "hot", "width", "n", "segment", "rank"])

        held: dict = {}
        for batch in pieces(batches, 1 << 21):
            ids = batch.column(0).field(batch.column(0).type.get_field_index("doc_id"))
            rank = pa.struct([("none", pa.bool_()), ("doc_id", ids.type), ("key", pa.int64()), ("check", pa.int64()), ("lo", pa.int64())])
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), rank]
            names, keys, checks = ids.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, h, c, lo, width, hot, segment in _found(batch, size):
                member = (names[k] is None, names[k], keys[k], checks[k], lo)
                if (seen := held.get((h, c))) is None:
                    if len(held) >= FOLD:
                        yield folded(held)
                        held = {}
                    held[h, c] = [1, member, hot, width, segment]
                else:
                    seen[0] += 1
                    if _order(member) < _order(seen[1]):
                        seen[1] = member
        if held:
            yield folded(held)

    return run


def _order(member: tuple) -> tuple:
    """Documents without an id come last."""
    return (member[0], 0 if member[0] else member[1], *member[2:])


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 21):
            rows = [x[:6] for x in _found(batch, size)]
            k, h, c, lo, _, hot = zip(*rows, strict=True) if rows else [[]] * 6
            index = pa.array(k, pa.int64())
            columns = [*(pa.array(x, pa.int64()) for x in (h, c)), pa.array(hot, pa.bool_()), batch.column(1).take(index), batch.column(2).take(index), pa.array(lo, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "hot", "key", "check", "lo"])

    return run


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def window_ranks(buffer: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The rank of the ``size`` bytes at each start, by prefix doubling; equal bytes have equal ranks."""
    padded = np.concatenate([buffer, np.zeros(size, np.uint8)])
    count = len(buffer)
    key = np.zeros(count, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + count]
    rank, reach = _dense(key), 8
    while reach * 2 <= size:
        far = np.concatenate([rank[reach:], np.zeros(reach, np.int64)])
        if reach * 4 <= size:
            rank = _dense(rank << 32 | far)
        else:
            break
        reach *= 2
    # windows are covered by pieces of `reach` bytes, the last one overlapping
    rest = rank[starts]
    covered = reach
    while covered < size:
        step = min(covered, size - reach)
        rest = _dense(rest << 32 | rank[starts + step])
        covered = step + reach
    return rest


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ranked = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return out


def matches(segments: list[bytes], widths: np.ndarray, order: np.ndarray, first: bool, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) pairs with an equal window in another segment; with ``first``, in an earlier one."""
    lengths = np.array([len(s) for s in segments])
    begin = np.cumsum(lengths) - lengths
    starts = spans(begin, widths)
    owner = np.repeat(np.arange(len(segments)), widths)
    rank = window_ranks(np.frombuffer(b"".join(segments), np.uint8), starts, size)
    suffix = np.lexsort((starts, order[owner], rank))
    same = rank[suffix[1:]] == rank[suffix[:-1]]  # the neighbours share `size` bytes
    hit = np.zeros(len(starts), bool)
    hit[suffix[1:][same]] = True  # the previous smaller position: an earlier copy
    if not first:
        hit[suffix[:-1][same]] = True  # the next one: a later copy
    found = np.flatnonzero(hit)
    return owner[found], starts[found] - begin[owner[found]]


#: scope of a verdict: all members of the class, the first of them only, all but the first
ALL, FIRST, OTHERS, DIGEST = 0, 1, 2, 3
RANK = "struct<none:boolean,doc_id:{},key:bigint,check:bigint,lo:bigint>"
JUDGED = "kind int, h long, c long, hot boolean, n long, since long, upto long, high long, low long, rank "


def _judge(first: bool, size: int):
    """Rows (unit, h, c, hot, width, n, segment, rank) sorted by unit and class: verdicts, or digests for hot hashes."""

    def full(rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            if r["n"] > 1:
                yield (OTHERS if first else ALL, r, 0, r["width"] - 1)

    def sort(rows: list[dict]) -> Iterator[tuple]:
        ranks = sorted({_order(r["rank"]) for r in rows})
        order = {x: k for k, x in enumerate(ranks)}
        owner, window = matches(
            [r["segment"] for r in rows], np.array([r["width"] for r in rows]), np.array([order[_order(r["rank"])] for r in rows]), first, size
        )
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)])) if len(owner) else owner
        last = np.append(new[1:], len(owner)) - 1 if len(owner) else new
        for k, since, upto in zip(owner[new].tolist(), window[new].tolist(), window[last].tolist(), strict=True):
            if first:
                yield (FIRST if rows[k]["n"] > 1 else ALL, rows[k], since, upto)
            elif rows[k]["n"] == 1:
                yield (ALL, rows[k], since, upto)

    def digests(row: dict) -> Iterator[tuple]:
        for k in range(row["width"]):
            value = xxhash.xxh3_128_intdigest(row["segment"][k : k + size])
            yield (DIGEST, row, k, k, (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                row["rank"] = tuple(row["rank"].values())
                if group and (row["h"], row["c"]) == (group[-1]["h"], group[-1]["c"]):  # folded by another task
                    group[-1]["n"] += row["n"]
                    group[-1]["rank"] = min(group[-1]["rank"], row["rank"], key=_order)
                    continue
                if group and (row["hot"] or row["unit"] != group[-1]["unit"]):
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[dict] = []
        weight = 0
        for group in groups(batches):
            yield from full(group)
            if group[0]["hot"]:
                for row in group:
                    yield from digests(row)
            elif len(group) > 1:
                held += group
                weight += sum(len(r["segment"]) for r in group)
                if weight >= BLOCK_BYTES:
                    yield from sort(held)
                    held, weight = [], 0
        if held:
            yield from sort(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind = None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in out], pa.int32())]
            columns += [pa.array([x[1][name] for x in out], k) for name, k in (("h", pa.int64()), ("c", pa.int64()), ("hot", pa.bool_()), ("n", pa.int64()))]
            columns += [pa.array([x[k] if len(x) > k else 0 for x in out], pa.int64()) for k in (2, 3, 4, 5)]
            fields = ("none", "doc_id", "key", "check", "lo")
            columns.append(pa.array([dict(zip(fields, x[1]["rank"], strict=True)) for x in out], kind))
            return pa.RecordBatch.from_arrays(columns, ["kind", "h", "c", "hot", "n", "since", "upto", "high", "low", "rank"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("rank").type
                yield b

        for verdict in judged(seen()):
            out.append(verdict)
            if len(out) >= 20_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def spans_of(documents: DataFrame, keep_first: bool = False, size: int = SIZE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The documents as (row, key, check), and (key, check, cuts): the byte ranges to remove of each."""
    if size < 64 or size > KMER + 255:
        raise ValueError(f"size must be from 64 to {KMER + 255}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.xxhash64("doc_id", "text").alias("key"), F.crc32(text).bitwiseAND(F.lit(0xFFFF)).alias("check")]
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    docs = documents.select(F.struct(*columns).alias("row"), *keys)
    keyed = documents.select(text.alias("text"), *keys)

    repeated = keyed.select("text").mapInArrow(_anchors_only(size), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = staged(repeated, "anchors")  # so that the join below is one that AQE can split
    placed = keyed.mapInArrow(_anchors_placed(size), "h long, key long, place long").join(repeated, "h")
    spot = F.col("place").bitwiseAND(F.lit((1 << 48) - 1)).bitwiseOR(F.when(F.col("n") > most, F.lit(1 << 48)).otherwise(F.lit(0)))
    spots = placed.select("key", F.shiftrightunsigned("place", 48).alias("check"), spot.alias("spot"))
    spots = spots.groupBy("key", "check").agg(F.collect_set("spot").alias("spots"))
    found = docs.join(spots, ["key", "check"]).select("row", "key", "check", "spots")

    rank = RANK.format(documents.schema["doc_id"].dataType.simpleString())
    classes = found.mapInArrow(_classes(size), f"h long, c long, hot boolean, width long, n long, segment binary, rank {rank}")
    unit = F.when(F.col("hot"), F.xxhash64("h", "c")).otherwise(F.col("h"))
    judged = classes.select(unit.alias("unit"), *classes.columns).repartition("unit").sortWithinPartitions("unit", "h", "c")
    judged = judged.mapInArrow(_judge(keep_first, size), JUDGED + rank)
    # Made once and read three times: the identity keeps all columns, so the exchange below it is one and the same.
    judged = judged.repartition("h", "c").mapInArrow(_same, JUDGED + rank)

    digests = judged.filter(F.col("kind") == DIGEST)
    met = digests.groupBy("high", "low").agg(F.count(F.lit(1)).alias("classes"), F.min(F.struct("rank", "since")).alias("least")).filter("classes > 1")
    again = digests.join(met, ["high", "low"])
    if keep_first:
        again = again.filter(F.struct("rank", "since") != F.col("least"))
        again = again.withColumn("kind", F.when(F.col("n") > 1, FIRST).otherwise(ALL))
    else:
        again = again.filter("n = 1").withColumn("kind", F.lit(ALL))
    names = ["kind", "h", "c", "hot", "rank", "since", "upto"]
    verdicts = judged.filter(F.col("kind") != DIGEST).select(*names).unionByName(again.select(*names))

    every = F.array(*[F.lit(k) for k in range(SALTS)])
    verdicts = verdicts.withColumn("salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0))))).drop("hot")
    members = found.mapInArrow(_members(size), "h long, c long, hot boolean, key long, check long, lo long")
    members = members.withColumn("salt", F.when(F.col("hot"), F.pmod("key", F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    first = (F.col("key") == F.col("rank.key")) & (F.col("check") == F.col("rank.check")) & (F.col("lo") == F.col("rank.lo"))
    applies = (F.col("kind") == ALL) | (F.when(first, FIRST).otherwise(OTHERS) == F.col("kind"))
    cuts = members.join(verdicts, ["h", "c", "salt"]).filter(applies)
    span = F.struct((F.col("lo") + F.col("since")).alias("since"), (F.col("lo") + F.col("upto") + size).alias("upto"))
    return docs, cuts.groupBy("key", "check").agg(F.collect_set(span).alias("cuts"))


def merged(cuts: list[dict]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; ranges that touch become one."""
    out: list[list[int]] = []
    for since, upto in sorted((c["since"], c["upto"]) for c in cuts):
        if out and since <= out[-1][1]:
            out[-1][1] = max(out[-1][1], upto)
        else:
            out.append([since, upto])
    return [tuple(x) for x in out]


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for since, upto in gone:
        parts.append(raw[at:since])
        at = upto
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges shrunk so that no character is cut in two."""
    out = []
    for since, upto in gone:
        while since < upto and raw[since] & 0xC0 == 0x80:
            since += 1
        while upto > since and upto < len(raw) and raw[upto] & 0xC0 == 0x80:
            upto -= 1
        if since < upto:
            out.append((since, upto))
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, cuts in zip(text_column(batch), batch.column(3), strict=True):
            raw, gone = text.as_py().encode("utf-8", "surrogatepass"), merged(cuts.as_py() or [])
            kept = kept_bytes(raw, gone)
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        ids = batch.column(0).field(batch.column(0).type.get_field_index("doc_id"))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(documents: DataFrame, keep_first: bool = False, size: int = SIZE, most: int = MOST) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    docs, cuts = spans_of(documents, keep_first, size, most)
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    return docs.join(cuts, ["key", "check"], "left").select("row", "key", "check", "cuts").mapInArrow(_report, schema)


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, left = [], []
        for text, cuts in zip(text_column(batch), batch.column(3), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            texts.append(kept_bytes(raw, whole_characters(raw, merged(cuts.as_py() or []))).decode("utf-8", "surrogatepass"))
            left.append(bool(texts[-1]) or not raw)
        row = batch.column(0)
        fields = [pa.array(texts, pa.string()) if f.name == "text" else row.field(k) for k, f in enumerate(row.type)]
        yield pa.RecordBatch.from_arrays(fields, [f.name for f in row.type]).filter(pa.array(left))


def cut(documents: DataFrame, keep_first: bool = True, size: int = SIZE, most: int = MOST) -> DataFrame:
    """The documents, all columns, with repeated bytes taken out of ``text``; no character is cut in two.

    Documents of which nothing is left are dropped; null texts come back empty.
    """
    docs, cuts = spans_of(documents, keep_first, size, most)
    joined = docs.join(cuts, ["key", "check"], "left").select("row", "key", "check", "cuts")
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in documents.schema.fields]
    return joined.mapInArrow(_shorten, T.StructType(fields))
