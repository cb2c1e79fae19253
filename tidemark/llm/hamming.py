"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is above zero. A task holds up to
``SHARD_ROWS`` codes with one index for each of four segments of the code. All query codes of a block
are searched together: the radius within a segment grows step by step, segment by segment. When the
first j + 1 segments have been searched to radius r and the others to r - 1, every code within
4 r + j bits has been seen, so a query is done once its k-th verified distance is no larger.

Queries go to the tasks in blocks of at most ``BLOCK_CODES`` distinct codes. Of rows with equal codes
only the k + 1 smallest ids can be among the nearest of any query, so a hot code is cut down to those
before it is shuffled; nothing else is left out.

Defined results: rows without an id or a vector, or with one of more than 64 elements, have no code and are neither
queries nor neighbours (project longer vectors first); missing or NaN elements give bit zero; rows with the query's own id are not its neighbours; ties go
to the smaller id; fewer than k rows give fewer neighbours; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import spans
from tidemark.session import staged

K, SEGMENTS, SEGMENT_BITS = 10, 4, 16
SHARD_ROWS, BLOCK_CODES, CANDIDATES = 1 << 18, 1 << 14, 1 << 21


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        row, place = np.repeat(np.arange(len(sizes)), sizes), spans(np.zeros(len(sizes), np.int64), sizes)
        code = np.zeros(len(sizes), np.uint64)
        set_ = values > 0
        np.bitwise_or.at(code, row[set_], weights[place[set_]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.view(np.int64))], ["vec_id", "code"])


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code) of (vec_id, embedding)."""
    there = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").dropna().filter(F.size("embedding") <= 64)
    return there.mapInArrow(_codes, "vec_id long, code long")


@functools.cache
def _flips(radius: int) -> np.ndarray:
    """All segments with this many bits."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(SEGMENT_BITS), radius)])


class Index:
    """Codes of a shard, with the rows of every value of every segment."""

    def __init__(self, ids: np.ndarray, code: np.ndarray):
        self.ids, self.code = ids, code
        self.distinct = len(np.unique(ids))
        self.rows, self.starts = [], []
        for segment in range(SEGMENTS):
            key = self.key(code, segment)
            rows = np.argsort(key, kind="stable")
            self.rows.append(rows)
            self.starts.append(np.searchsorted(key[rows], np.arange((1 << SEGMENT_BITS) + 1)))

    @staticmethod
    def key(code: np.ndarray, segment: int) -> np.ndarray:
        return (code >> np.uint64(segment * SEGMENT_BITS) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)

    def candidates(self, code: np.ndarray, segment: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) pairs whose segment differs in exactly ``radius`` bits, CANDIDATES or so at a time."""
        flips = _flips(radius)
        starts, rows = self.starts[segment], self.rows[segment]
        key = self.key(code, segment)
        if len(flips) > len(self.code):  # fewer rows than keys to look up: compare the rows' keys instead
            held = self.key(self.code, segment).astype(np.uint64)
            step = max(1, CANDIDATES // len(held))
            for at in range(0, len(code), step):
                q, row = np.nonzero(np.bitwise_count(key[at : at + step, None].astype(np.uint64) ^ held) == radius)
                yield at + q, row
            return
        step = max(1, CANDIDATES // len(flips))
        for at in range(0, len(code), step):
            wanted = (key[at : at + step, None] ^ flips).ravel()
            count = starts[wanted + 1] - starts[wanted]
            some = np.flatnonzero(count)
            cuts = np.searchsorted(np.cumsum(count[some]), np.arange(CANDIDATES, int(count.sum()) + CANDIDATES, CANDIDATES), "left") + 1
            begin = 0
            for stop in np.unique(np.minimum(cuts, len(some))).tolist():
                part = some[begin:stop]
                begin = stop
                yield np.repeat(at + part // len(flips), count[part]), rows[spans(starts[wanted[part]], count[part])]

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id) of the k nearest distinct ids of each query code, ties by id."""
        none = np.zeros(0, np.int64)
        found = (none, none, none)  # query, distance, row
        active = np.arange(len(query))
        for radius in range(SEGMENT_BITS + 1):
            for segment in range(SEGMENTS):
                for q, row in self.candidates(query[active], segment, radius):
                    q = active[q]
                    distance = np.bitwise_count(query[q] ^ self.code[row]).astype(np.int64)
                    found = self._best(*(np.concatenate(x) for x in zip(found, (q, distance, row), strict=True)), k)
                kept = np.bincount(found[0], minlength=len(query))
                worst = np.zeros(len(query), np.int64)
                np.maximum.at(worst, found[0], found[1])
                covered = SEGMENTS * radius + segment
                active = active[~((kept[active] >= min(k, self.distinct)) & (worst[active] <= covered))]
                if not len(active):
                    return found[0], found[1], self.ids[found[2]]
        return found[0], found[1], self.ids[found[2]]

    def _best(self, q: np.ndarray, distance: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((distance, self.ids[row], q))  # an id counts once, with its nearest row
        q, distance, row = q[order], distance[order], row[order]
        ids = self.ids[row]
        fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, bool)
        q, distance, row = q[fresh], distance[fresh], row[fresh]
        order = np.lexsort((self.ids[row], distance, q))
        q, distance, row = q[order], distance[order], row[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        return q[keep], distance[keep], row[keep]


def _search(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = held.value

        def searched(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            index = Index(table.column("vec_id").to_numpy(), table.column("code").to_numpy().view(np.uint64))
            q, distance, ids = index.nearest(query, k)
            return pa.RecordBatch.from_arrays([pa.array(query[q].view(np.int64)), pa.array(distance.astype(np.int32)), pa.array(ids)], ["code", "distance", "neighbour_id"])

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts.append(batch)
            if sum(map(len, parts)) >= SHARD_ROWS:
                yield searched(parts)
                parts = []
        if sum(map(len, parts)):
            yield searched(parts)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_codes: int = BLOCK_CODES) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest ids of every query, by Hamming distance of the codes."""
    spark = vectors.sparkSession
    coded = codes(vectors)
    same = Window.partitionBy("code").orderBy("vec_id")
    rows = staged(coded.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("vec_id", "code"), "codes")
    asked = staged(codes(queries).distinct(), "queries")
    distinct = asked.select("code").distinct()
    count = -(-distinct.count() // block_codes)
    found = None
    for block in range(count):
        part = distinct.filter(F.pmod(F.xxhash64("code"), F.lit(count)) == block).collect()  # about block_codes numbers
        held = spark.sparkContext.broadcast(np.array(sorted(r["code"] for r in part), np.int64).view(np.uint64))
        near = rows.mapInArrow(_search(held, k + 1), "code long, distance int, neighbour_id long")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance int")
    best = Window.partitionBy("code").orderBy("distance", "neighbour_id")
    # an id that stands in several rows counts once, with its nearest code, before the cut
    found = found.groupBy("code", "neighbour_id").agg(F.min("distance").alias("distance"))
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    own = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(found, "code").filter("query_id <> neighbour_id")
    # a query id may have several codes too
    pairs = pairs.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")
