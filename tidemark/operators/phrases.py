"""Shingle keys of many texts in packed blocks: what the Python workers of the phrase jobs in ``text`` do.

All of it is made inside functions and sent by value, so a worker needs no copy of this package.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Entries (a shingle of a text) that a block holds, and bytes of text that are cut at a time.
BLOCK_ENTRIES = 1 << 20
CUT_BYTES = 4 << 20


def coder() -> tuple[Callable, Callable, Callable, Callable]:
    """Functions that write and read numbers in as few bits as the largest needs, and sorted entries."""
    head, few = "<IIBBBI", "<IB"  # entries, different keys, bits of the prefix, a step and a unit, companies; numbers, bits of one

    def bits(values: np.ndarray, width: int) -> bytes:
        planes = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.packbits(planes[:, :width], bitorder="little").tobytes()

    def unbits(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
        end = at + (n * width + 7) // 8
        planes = np.zeros((n, 64), np.uint8)
        planes[:, :width] = np.unpackbits(np.frombuffer(data[at:end], np.uint8), count=n * width, bitorder="little").reshape(n, width)
        return np.packbits(planes, axis=1, bitorder="little").view("<u8").reshape(-1), end

    def width_of(values: np.ndarray) -> int:
        return max(1, int(values.max(initial=0)).bit_length())

    def write(hi: np.ndarray, lo: np.ndarray, fresh: np.ndarray, unit: np.ndarray, prefix: int, firsts: np.ndarray) -> bytes:
        steps = np.diff(hi[fresh], prepend=hi[0] >> np.uint64(64 - prefix) << np.uint64(64 - prefix))
        step, number = width_of(steps), width_of(unit)
        parts = (np.packbits(fresh).tobytes(), lo[fresh].tobytes(), firsts.astype("<u4").tobytes(), bits(steps, step), bits(unit, number))
        return b"".join((struct.pack(head, len(unit), len(steps), prefix, step, number, len(firsts)), *parts))

    def read(data: bytes, begin: int) -> tuple[np.ndarray, ...]:
        """Of the keys that begin with ``begin``: hi and lo of the different keys; key and unit of the entries; first unit of each company."""
        n, m, prefix, step, number, companies = struct.unpack_from(head, data)
        at = struct.calcsize(head)
        end = at + (n + 7) // 8
        key = np.cumsum(np.unpackbits(np.frombuffer(data[at:end], np.uint8), count=n), dtype=np.int64) - 1
        lo = np.frombuffer(data, "<u4", m, end)
        firsts = np.frombuffer(data, "<u4", companies, end + 4 * m)
        steps, at = unbits(data, end + 4 * (m + companies), m, step)
        unit = unbits(data, at, n, number)[0].astype(np.int64)
        return np.uint64(begin << (64 - prefix)) + np.cumsum(steps, dtype=np.uint64), lo, key, unit, firsts

    def write_few(values: np.ndarray) -> bytes:
        width = width_of(values)
        return struct.pack(few, len(values), width) + bits(values, width)

    def read_few(data: bytes) -> np.ndarray:
        return unbits(data, struct.calcsize(few), *struct.unpack_from(few, data))[0].astype(np.int64)

    return write, read, write_few, read_few


def in_order() -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the order by hi, lo and number; lo and number are looked at where hi is equal only."""

    def order_of(hi: np.ndarray, lo: np.ndarray, number: np.ndarray) -> np.ndarray:
        order = np.argsort(hi, kind="stable")
        if len(order) > 1:
            same = hi[order][1:] == hi[order][:-1]
            again = np.append(same, False) | np.append(False, same)
            some = order[again]
            order[again] = some[np.lexsort((number[some], lo[some], hi[some]))]
        return order

    return order_of


def cutter(n: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function from lower-cased texts to all their shingles: 64 and 32 bits of the key, and the row."""
    word_byte = np.zeros(256, bool)
    word_byte[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
    factors = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Words are runs of ASCII letters and digits, as in ``functions.text.words``: in UTF-8 they are runs of such bytes.
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = word_byte[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = inside[heads]
        per_row = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
        places = np.append(np.flatnonzero(begins[inside]), inside.sum()).astype(np.int32)
        count = len(places) - 1
        row = np.repeat(np.arange(len(texts), dtype=np.int64), per_row)
        if count < n:
            return np.empty(0, np.uint64), np.empty(0, np.uint32), row[:0]
        words = pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer(places), pa.py_buffer(data[inside])]).dictionary_encode()
        digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.dictionary.to_pylist())
        digests = np.frombuffer(digests, "<u8").reshape(-1, 2)
        code, last = words.indices.to_numpy(), count - n + 1
        whole = row[:last] == row[n - 1 :]  # all words are of one text
        keys = []
        for half, factor in enumerate(factors):
            of_word = np.ascontiguousarray(digests[:, half])[code]
            mixed = np.zeros(last, np.uint64)
            for k in range(n):
                mixed ^= of_word[k : k + last]
                mixed *= factor
                mixed ^= mixed >> np.uint64(32)
            keys.append(mixed[whole])
        return keys[0], (keys[1] >> np.uint64(32)).astype(np.uint32), row[:last][whole]

    return cut


def packed(n: int, prefix: int, several: bool, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, company, lower-cased text) to blocks of sorted entries, one row for the keys with the same first bits.

    An entry is a key with a unit: a document with a company, numbered by company. Units are numbered in the block, whose
    own row lists them with their counts. If a document may have ``several`` rows, which can be in several blocks, units are
    numbered in the row, which lists their documents.
    """
    (write, _, _, _), order_of, cut, arrow = coder(), in_order(), cutter(n), to_arrow_schema(schema)
    most, step = BLOCK_ENTRIES, CUT_BYTES

    def lists(values: pa.Array, sizes: list[int], kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values).cast(kind)

    def block(number: int, docs: pa.Array, companies: pa.Array, hi: np.ndarray, lo: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        companies, size = companies.dictionary_encode(null_encoding="encode"), len(docs)
        doc = docs.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) if several else np.arange(size)
        units, at, unit_of = np.unique(companies.indices.to_numpy().astype(np.int64) * size + doc, return_index=True, return_inverse=True)
        unit, company = unit_of[row], units // size
        order = order_of(hi, lo, unit)
        hi, lo, unit = hi[order], lo[order], unit[order]
        fresh = np.ones(len(hi), bool)
        fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        kept = fresh.copy()
        kept[1:] |= unit[1:] != unit[:-1]
        hi, lo, unit, fresh = hi[kept], lo[kept], unit[kept], fresh[kept]
        if not several:
            counts = pa.array(np.bincount(unit, minlength=len(units)), pa.int64())
            told = [lists(values, [len(units)], arrow[k].type) for k, values in ((4, docs.take(pa.array(at))), (5, counts))]
            one = pa.array([number], pa.int64())
            yield pa.RecordBatch.from_arrays([one, one, pa.nulls(1, pa.binary()), pa.nulls(1, arrow[3].type), *told], schema=arrow)
        bucket = hi >> np.uint64(64 - prefix)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        ends = np.append(starts[1:], len(hi))
        begin = np.searchsorted(company, np.arange(len(companies.dictionary)))
        for k in range(0, len(starts), 1024):
            rows, here, owners = [], [], []
            for s, e in zip(starts[k : k + 1024], ends[k : k + 1024], strict=True):
                there, numbers = np.unique(unit[s:e], return_inverse=True)
                owners.append(there)
                here.append(np.unique(company[there]))
                firsts = np.searchsorted(company[there], here[-1]) if several else begin[here[-1]]
                rows.append(write(hi[s:e], lo[s:e], fresh[s:e], numbers if several else unit[s:e], prefix, firsts))
            dealt = [pa.array(bucket[starts[k : k + 1024]].astype(np.int64)), pa.array(np.full(len(rows), number)), pa.array(rows, pa.binary())]
            dealt.append(lists(companies.dictionary.take(pa.array(np.concatenate(here))), [len(x) for x in here], arrow[3].type))
            told = lists(docs.take(pa.array(at[np.concatenate(owners)])), [len(x) for x in owners], arrow[4].type) if several else pa.nulls(len(rows), arrow[4].type)
            yield pa.RecordBatch.from_arrays([*dealt, told, pa.nulls(len(rows), arrow[5].type)], schema=arrow)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held = TaskContext.get().partitionId(), 0, []
        entries = rows = 0

        def gathered() -> Iterator[pa.RecordBatch]:
            number = -1 - ((task << 32) | done)
            return block(number, *(pa.concat_arrays([x[k] for x in held]) for k in (0, 1)), *(np.concatenate([x[k] for x in held]) for k in (2, 3, 4)))

        for batch in batches:
            docs, companies, texts = batch.column(0), batch.column(1), batch.column(2).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            s = 0
            while s < len(texts):
                e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + step, "right")) - 1)
                hi, lo, row = cut(texts.slice(s, e - s))
                held.append((docs.slice(s, e - s), companies.slice(s, e - s), hi, lo, row + rows))
                entries, rows, s = entries + len(hi), rows + e - s, e
                if max(entries, rows) >= most:
                    yield from gathered()
                    held, entries, rows, done = [], 0, 0, done + 1
        if held:
            yield from gathered()

    return blocks


def counted(least: int, schema: T.StructType) -> Callable[[tuple, pa.Table], pa.Table]:
    """The rows of the same first bits to their keys that ``least`` companies have, and how many have them."""
    (_, read, _, _), order_of, arrow = coder(), in_order(), to_arrow_schema(schema)
    whole = np.dtype([("hi", ">u8"), ("lo", ">u4")])

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        begin = key[0].as_py()
        if begin < 0:
            return arrow.empty_table()
        listed = rows.column(3).combine_chunks()
        codes = listed.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy()
        at, his, los, companies = 0, [], [], []
        for data, size in zip(rows.column(2), listed.value_lengths().to_pylist(), strict=True):
            hi, lo, number, unit, firsts = read(data.as_py(), begin)
            company = codes[at : at + size][np.searchsorted(firsts, unit, "right") - 1]
            at += size
            again = np.append(False, (number[1:] == number[:-1]) & (company[1:] == company[:-1]))[: len(number)]
            his.append(hi[number[~again]])
            los.append(lo[number[~again]])
            companies.append(company[~again])
        hi, lo, company = np.concatenate(his), np.concatenate(los), np.concatenate(companies)
        order = order_of(hi, lo, company)
        hi, lo, company = hi[order], lo[order], company[order]
        fresh = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
        other = fresh | np.append(True, company[1:] != company[:-1])
        starts = np.flatnonzero(fresh)
        number = np.add.reduceat(other.astype(np.int64), starts)
        starts, number = starts[number >= least], number[number >= least]
        keys = np.empty(len(starts), whole)
        keys["hi"], keys["lo"] = hi[starts], lo[starts]
        places = pa.py_buffer((np.arange(len(keys) + 1) * whole.itemsize).astype(np.int32))
        more = pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, places, pa.py_buffer(keys.tobytes())])
        return pa.Table.from_arrays([pa.array(np.full(len(keys), begin)), more, pa.array(number)], schema=arrow)

    return count


def marked(schema: T.StructType) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The rows of the same first bits, beside the shared keys there, to what a block or a document gets to know.

    A block gets its units that have a shared key, as often as they have one. Of documents with several rows, which meet
    here only, the different keys and the shared ones among them are counted.
    """
    (_, read, write_few, _), order_of, arrow = coder(), in_order(), to_arrow_schema(schema)
    whole = np.dtype([("hi", ">u8"), ("lo", ">u4")])

    def among(hi: np.ndarray, lo: np.ndarray, his: np.ndarray, los: np.ndarray) -> np.ndarray:
        found, live = np.zeros(len(hi), bool), np.arange(len(hi))
        at = np.searchsorted(his, hi)
        while len(live):  # on to the next key where only hi was the same
            there = at < len(his)
            live, at = live[there], at[there]
            there = his[at] == hi[live]
            live, at = live[there], at[there]
            hit = los[at] == lo[live]
            found[live[hit]] = True
            live, at = live[~hit], at[~hit] + 1
        return found

    def mark(key: tuple, rows: pa.Table, shared: pa.Table) -> pa.Table:
        begin = key[0].as_py()
        if begin is None or not len(rows):
            return arrow.empty_table()
        if begin < 0:
            return pa.Table.from_arrays([rows.column(0), rows.column(4), rows.column(5), pa.nulls(len(rows), pa.binary())], schema=arrow)
        keys = np.frombuffer(b"".join(k for one in shared.column(1).to_pylist() for k in one), whole)
        his, los = keys["hi"].astype(np.uint64), keys["lo"].astype(np.uint32)
        order = np.lexsort((los, his))
        his, los = his[order], los[order]
        listed = rows.column(4).combine_chunks()
        docs = listed.flatten().dictionary_encode(null_encoding="encode")
        code, at, blocks, hits, split = docs.indices.to_numpy(), 0, [], [], []
        for number, data, size in zip(rows.column(1).to_pylist(), rows.column(2), listed.value_lengths().to_pylist(), strict=True):
            if size is None and not len(his):
                continue
            hi, lo, of, unit, _ = read(data.as_py(), begin)
            if size is not None:
                split.append((hi[of], lo[of], code[at : at + size][unit]))
                at += size
            elif len(units := unit[among(hi, lo, his, los)[of]]):
                blocks.append(number)
                hits.append(write_few(units))
        names, counts = [pa.nulls(len(blocks), arrow[k].type) for k in (1, 2)]
        out = pa.Table.from_arrays([pa.array(blocks, pa.int64()), names, counts, pa.array(hits, pa.binary())], schema=arrow)
        if not split:
            return out
        hi, lo, doc = (np.concatenate([x[k] for x in split]) for k in range(3))
        order = order_of(hi, lo, doc)
        hi, lo, doc = hi[order], lo[order], doc[order]
        other = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1]))
        hi, lo, doc = hi[other], lo[other], doc[other]
        found = np.bincount(doc[among(hi, lo, his, los)], minlength=len(docs.dictionary))
        counts = pa.array([np.bincount(doc, minlength=len(docs.dictionary))], arrow[2].type)
        names = pa.ListArray.from_arrays(pa.array([0, len(docs.dictionary)], pa.int32()), docs.dictionary).cast(arrow[1].type)
        told = [pa.array([begin], pa.int64()), names, counts, pa.array([found.astype("<i8").tobytes()], pa.binary())]
        return pa.concat_tables([out, pa.Table.from_arrays(told, schema=arrow)])

    return mark


def added_up(schema: T.StructType) -> Callable[[tuple, pa.Table], pa.Table]:
    """What is known of a block, or of documents with several rows: (doc, phrase_count, boilerplate_phrases)."""
    (_, _, _, read_few), arrow = coder(), to_arrow_schema(schema)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        docs, counts = (rows.column(k).combine_chunks().flatten() for k in (1, 2))
        hits = np.zeros(len(docs), np.int64)
        for data in rows.column(3).drop_null():
            hits += np.frombuffer(data.as_py(), "<i8") if key[0].as_py() >= 0 else np.bincount(read_few(data.as_py()), minlength=len(docs))
        return pa.Table.from_arrays([docs.cast(arrow[0].type), counts, pa.array(hits)], schema=arrow)

    return add
