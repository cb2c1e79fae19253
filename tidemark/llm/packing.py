"""Best-fit packing of token sequences by exact-complement hashing.

1. One pass tokenizes whole texts, cuts long ones and writes one row per piece, with a rank of the
   piece among those of its length in its task. The table is written once to the shared folder.
2. The plan is made from the histogram of lengths, which has at most ``capacity`` rows whatever the
   corpus. An index of available lengths and pair sums finds one, two or three lengths that fill a
   gap exactly; such a pattern is taken as often as its lengths allow. Where nothing fits exactly,
   the longest length that fits goes in. A pattern is taken until one of its lengths has fewer pieces
   left than the pattern needs, so there are at most about ``capacity * log(capacity)`` patterns.
3. A piece's rank among all of its length (rank in task + offset of the task) gives its pattern,
   sequence and place. No window or sort over pieces is needed, so a hot length is no problem.

Defined results: a null or empty text is one piece that holds the end token alone; repeated rows
are packed each; an empty table gives an empty table; a text longer than a sequence is cut in pieces
of ``capacity`` tokens, of which the last may be shorter. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import pieces
from tidemark.llm.tokens import packed
from tidemark.session import staged

CAPACITY, END_TOKEN = 4096, 1
PIECE_BYTES = 4 << 20


def _cut(path: str, capacity: int, end_token: int):
    end = np.array([end_token], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = packed(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, PIECE_BYTES):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for k, ids in enumerate(tokenizer.texts([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    size = len(part) // 4
                    row.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    rank.append(int(seen[size]))
                    seen[size] += 1
            columns = [pa.array(x, k) for x, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (rank, pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns, pa.array([task] * len(row), pa.int32())], names)

    return run


def cut_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its rank by length in its task."""
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    fields = [source.schema["doc_id"], T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "rank")]
    return source.mapInArrow(_cut(tokenizer, capacity, end_token), T.StructType([*fields, T.StructField("task", T.IntegerType())]))


class Sums:
    """Available lengths, and for each sum the number of pairs of available lengths that make it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.capacity = len(counts) - 1
        self.there = counts > 0
        self.there[0] = False
        self.pairs = np.zeros(2 * self.capacity + 1, np.int64)
        for a in np.flatnonzero(self.there):
            self.pairs[a : a + a + 1] += self.there[: a + 1]  # b <= a

    def remove(self, length: int) -> None:
        """The last piece of this length is used."""
        self.pairs[length : length + self.capacity + 1] -= self.there
        self.there[length] = False

    def pair(self, total: int, free: np.ndarray) -> tuple[int, int] | None:
        """Two free lengths of this sum, the longer as long as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        half = np.arange((total + 1) // 2, min(total, self.capacity + 1))
        good = (free[half] > 0) & (free[total - half] > 0) & ((half * 2 != total) | (free[half] > 1))
        found = np.flatnonzero(good)
        return (int(half[found[-1]]), total - int(half[found[-1]])) if len(found) else None

    def exact(self, gap: int, free: np.ndarray) -> list[int] | None:
        """One, two or three free lengths that fill the gap exactly."""
        if free[gap] > 0:
            return [gap]
        if two := self.pair(gap, free):
            return list(two)
        third = np.arange(gap - 2, 0, -1)
        for c in third[(free[third] > 0) & (self.pairs[gap - third] > 0)].tolist():
            free[c] -= 1
            two = self.pair(gap - c, free)
            free[c] += 1
            if two:
                return [c, *two]
        return None


def make_plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use all pieces; ``counts[n]`` pieces have length n."""
    counts = counts.astype(np.int64).copy()
    capacity, sums, plan = len(counts) - 1, Sums(counts), []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan
        free, pattern, gap = counts.copy(), [longest], capacity - longest
        free[longest] -= 1
        while gap:
            if filled := sums.exact(gap, free):
                pattern += filled
                break
            fitting = np.flatnonzero(free[1 : gap + 1])
            if not len(fitting):
                break
            pattern.append(int(fitting[-1]) + 1)
            free[pattern[-1]] -= 1
            gap -= pattern[-1]
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((counts[lengths] // uses).min())
        counts[lengths] -= times * uses
        sums.counts = counts
        for length in lengths[counts[lengths] == 0].tolist():
            sums.remove(length)
        plan.append((times, sorted(pattern, reverse=True)))


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces per sequence, first offset), in order of rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.setdefault(length, []).append((used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + times * each
            offset += each * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _place(held):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = held.value
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, rows in frame.groupby("length").indices.items():
                slot, rank = table[length], frame["rank"].to_numpy()[rows]
                s = slot[np.searchsorted(slot[:, 0], rank, "right") - 1]
                within = rank - s[:, 0]
                sequence[rows] = s[:, 1] + within // s[:, 2]
                offset[rows] = s[:, 3] + within % s[:, 2] * length
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of the vocabulary file, on every executor.
    """
    cut = staged(cut_pieces(documents, tokenizer, capacity, end_token), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = staged(by_task, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    held = documents.sparkSession.sparkContext.broadcast(slots(make_plan(counts)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.sum("n").over(earlier).alias("before"))
    ranked = cut.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank")
    )
    schema = T.StructType([*ranked.drop("rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(_place(held), schema)

