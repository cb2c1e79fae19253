"""Ranked lexical search of whole documents by branch and bound over frequency-ordered prefix trees.

The items are the queries. They go to the tasks in blocks of a bounded number of terms, and the terms of a
block are the vocabulary to which documents are restricted: one pass over the texts writes each document's
(term, occurrences) pairs in the shared folder, the document frequencies are counted from those, and a second
pass searches them.

In a task, some ``SHARD_TERMS`` pairs at a time make a prefix tree: the terms of a document are ordered by
falling document frequency, and documents with the same first terms share a path. A header list of every
term holds its documents in the order of the tree, so each subtree is a range of it; the largest number
of occurrences in such a range, and the smallest length measure m of the subtree, bound what any document
below can score. Every item goes through the tree depth first, the most promising child first, and leaves out
subtrees whose bound is below its ``k``-th best score so far, which it takes along from one tree to the next.
Subtrees of few documents are scored at once. A task passes on ``k`` documents of each item.

Defined results: null texts and texts without terms are no documents, items without terms have no results;
rows of the items with the same item_id are one item, equal rows of it count once; every row of the documents
is a document, so repeated rows are ranked apart; equal scores are ordered by doc_id, null last; empty tables
give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.columns import lists, pieces, spans, text_column, utf8
from tidemark.llm.decontaminate import word_hashes
from tidemark.session import staged

#: Fixed: the parts of a score.
WEIGHT, FULL, GROWTH, LENGTH, FLAT, SHARE = 1000, 1_000_000_000, 1000, 12, 75, 25
K = 20
#: Distinct terms of the items of a block, bytes of text counted at a time, pairs of a tree, documents scored at once.
BLOCK_TERMS, PIECE_BYTES, SHARD_TERMS, LEAF = 200_000, 4 << 20, 1 << 19, 64


def measure(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m: how long a document of n terms is, 100 for the mean."""
    if documents * SHARE * int(n.max(initial=0)) < 2**62:
        return FLAT + (SHARE * n * documents) // words
    return np.array([FLAT + (SHARE * v * documents) // words for v in n.tolist()], np.int64)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs tf times adds to a score, before its weight. Grows with tf and falls with m."""
    return (FULL * tf) // (GROWTH * tf + LENGTH * m)


def weight(df: int, documents: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted; the number of a term is its place

    def restrict(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and its distinct known ones: row, number, occurrences."""
        words, first = word_hashes(*utf8(text_column(batch)))
        place = np.searchsorted(self.hashes, words)
        place[place == len(self.hashes)] = 0
        known = np.flatnonzero(self.hashes[place] == words)
        row = np.searchsorted(first, known, "right") - 1
        pair, tf = np.unique(row * len(self.hashes) + place[known], return_counts=True)
        return np.diff(first), pair // len(self.hashes), pair % len(self.hashes), tf


def _restrict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in pieces(batches, PIECE_BYTES):
            n, row, term, tf = vocabulary.restrict(batch)
            offsets = np.searchsorted(row, np.arange(len(batch) + 1))
            vectors = [lists(offsets, term.astype(np.int32)), lists(offsets, tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *vectors], ["doc_id", "n", "terms", "tf"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, PIECE_BYTES):
        words, first = word_hashes(*utf8(text_column(batch)))
        row = np.repeat(np.arange(len(batch)), np.diff(first))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(words.view(np.int64))], ["item_id", "term"])


@dataclass
class Item:
    terms: np.ndarray  # numbers in the vocabulary, sorted
    weights: np.ndarray  # weight times occurrences in the item
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # best first
    none: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def least(self, k: int) -> int:
        """What a score has to reach."""
        return max(1, int(self.score[-1])) if len(self.score) == k else 1

    def offer(self, score: np.ndarray, none: np.ndarray, doc: np.ndarray, k: int) -> None:
        good = np.flatnonzero(score >= self.least(k))
        if len(good):
            score, none, doc = (np.concatenate(x) for x in ((self.score, score[good]), (self.none, none[good]), (self.doc, doc[good])))
            order = np.lexsort((doc, none, -score))[:k]
            self.score, self.none, self.doc = score[order], none[order], doc[order]


@dataclass
class Node:
    """The documents [low, high) of the tree's order; its children follow each other there."""

    low: int
    high: int
    bounds: np.ndarray | None = None  # of the children: where each begins, and the end
    children: list[Node] = field(default_factory=list)


class Tree:
    """Prefix tree of documents over terms by falling frequency, with header lists."""

    def __init__(self, doc: np.ndarray, none: np.ndarray, m: np.ndarray, sizes: np.ndarray, rank: np.ndarray, tf: np.ndarray):
        """``rank`` holds the terms of all documents by frequency (0: most frequent), ascending in each."""
        ends = np.cumsum(sizes)
        raw, begin = rank.astype(">u4").tobytes(), ends - sizes
        paths = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.doc, self.none, self.m, self.sizes = doc[order], none[order], m[order], sizes[order]
        at = spans(begin[order], self.sizes)
        self.rank, self.start = rank[at], np.cumsum(self.sizes) - self.sizes
        place = np.repeat(np.arange(len(order)), self.sizes)
        header = np.argsort(self.rank, kind="stable")  # by term, then by place in the tree
        self.count = len(order)
        self.header = self.rank[header] * self.count + place[header]
        tf = tf[at][header]
        self.place = place[header]
        self.added = part(tf, self.m[self.place])
        self.most = [tf]  # level j: the largest of 2 ** j neighbours
        longest = int(np.bincount(self.rank).max()) if len(self.rank) else 0
        while 1 << len(self.most) <= longest:
            half = 1 << (len(self.most) - 1)
            last = self.most[-1]
            self.most.append(np.maximum(last[:-half], last[half:]))
        self.root = self.grow(0, self.count, 0)

    def grow(self, low: int, high: int, depth: int) -> Node:
        """The node of documents that share their first ``depth`` terms."""
        root = Node(low, high)
        todo = [(root, depth)]
        while todo:
            node, depth = todo.pop()
            if node.high - node.low <= LEAF:
                continue
            first, last = (self.rank[self.start[p] : self.start[p] + self.sizes[p]] for p in (node.low, node.high - 1))
            shared = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:shared] != last[depth:shared])
            depth = depth + int(differ[0]) if len(differ) else shared  # a path without branches is one node
            at = np.arange(node.low, node.high)
            goes_on = self.sizes[at] > depth
            term = np.full(len(at), -1, np.int64)
            term[goes_on] = self.rank[self.start[at[goes_on]] + depth]
            cuts = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(at)]])
            if len(cuts) == 2:  # equal paths to the end: halves
                cuts = np.append(np.arange(0, len(at), LEAF), len(at))
                node.bounds = node.low + cuts
                node.children = [Node(a, b) for a, b in zip(node.bounds.tolist(), node.bounds[1:].tolist(), strict=False)]
                continue
            # small neighbours share a leaf
            joined, held = [0], 0
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if held and (held + b - a > LEAF):
                    joined.append(a)
                    held = 0
                held += b - a
            node.bounds = node.low + np.array([*joined, len(at)])
            for a, b in zip(node.bounds.tolist(), node.bounds[1:].tolist(), strict=False):
                child = Node(a, b)
                node.children.append(child)
                if term[a - node.low] == term[b - 1 - node.low]:
                    todo.append((child, depth + 1))
        return root

    def ranges(self, ranks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the ranges [bounds[i], bounds[i + 1]) begin in the header list of each term; a row per term."""
        return np.searchsorted(self.header, ranks[:, None] * self.count + bounds)

    def upper(self, at: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each range an upper bound of the scores in it."""
        low, high = at[:, :-1], at[:, 1:]
        size = high - low
        level = np.frexp(np.maximum(size, 1))[1] - 1
        most = np.zeros(size.shape, np.int64)
        for j in np.unique(level[size > 0]).tolist():
            here = (level == j) & (size > 0)
            row = self.most[j]
            most[here] = np.maximum(row[low[here]], row[high[here] - (1 << j)])
        least = np.minimum.reduceat(self.m, bounds[:-1])
        return (weights[:, None] * part(most, least)).sum(axis=0)

    def scores(self, at: np.ndarray, chosen: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the documents of the chosen ranges that hold a term of the item."""
        low, size = at[:, :-1][:, chosen], (at[:, 1:] - at[:, :-1])[:, chosen]
        entry = spans(low.ravel(), size.ravel())
        value = self.added[entry] * np.repeat(np.broadcast_to(weights[:, None], size.shape).ravel(), size.ravel())
        place, which = np.unique(self.place[entry], return_inverse=True)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, which, value)
        return place, total

    def search(self, item: Item, ranks: np.ndarray, k: int) -> None:
        """Depth first, the child with the highest bound first; subtrees below the k-th score are left out."""
        if not self.count or not len(ranks):
            return
        if not self.root.children:
            bounds = np.array([0, self.count])
            self.offer(item, *self.scores(self.ranges(ranks, bounds), np.array([0]), bounds, item.weights), k)
            return
        stack = [(0, self.root)]
        while stack:
            bound, node = stack.pop()
            if bound and bound < item.least(k):
                continue
            at = self.ranges(ranks, node.bounds)
            upper = self.upper(at, node.bounds, item.weights)
            alive = np.flatnonzero(upper >= item.least(k))
            alive = alive[np.argsort(upper[alive], kind="stable")]
            ends = np.array([not node.children[c].children for c in alive.tolist()], bool)
            if ends.any():
                self.offer(item, *self.scores(at, alive[ends], node.bounds, item.weights), k)
            stack += [(int(upper[c]), node.children[c]) for c in alive[~ends].tolist()]

    def offer(self, item: Item, place: np.ndarray, score: np.ndarray, k: int) -> None:
        item.offer(score, self.none[place], self.doc[place], k)


@dataclass
class Search:
    """A block of items with what is known of all documents."""

    ids: list
    items: list[tuple[np.ndarray, np.ndarray]]  # term numbers and weights
    rank: np.ndarray  # of a term: its place by falling document frequency
    documents: int
    words: int

    def run(self, batches: Iterator[pa.RecordBatch], k: int, shard_terms: int) -> list[Item]:
        items = [Item(terms, weights) for terms, weights in self.items]
        ranks = [self.rank[item.terms] for item in items]
        held: list[pa.RecordBatch] = []
        pairs = 0

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            tree = self.tree(table)
            for item, rank in zip(items, ranks, strict=True):
                tree.search(item, rank, k)

        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            at = 0
            while at < len(batch):
                after = int(np.searchsorted(ends, ends[at] + shard_terms - pairs, "right")) - 1
                after = min(max(after, at + (not held)), len(batch))
                if after > at:
                    held.append(batch.slice(at, after - at))
                    pairs += int(ends[after] - ends[at])
                    at = after
                if at < len(batch):
                    search()
                    held, pairs = [], 0
        if held:
            search()
        return items

    def tree(self, table: pa.Table) -> Tree:
        doc, n, terms, tf = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        none = doc.is_null().to_numpy(zero_copy_only=False)
        number = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        rank, tf = self.rank[terms.flatten().to_numpy()], tf.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rank, owner))
        m = measure(n.to_numpy().astype(np.int64), self.documents, self.words)
        return Tree(number, none, m, sizes, rank[order], tf[order])


def _search(held, k: int, shard_terms: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = held.value
        for item_id, item in zip(search.ids, search.run(batches, k, shard_terms), strict=True):
            if len(item.score):
                doc = pa.array(item.doc, pa.int64(), mask=item.none)
                found = [pa.array([item_id] * len(item.score), schema.field(0).type), doc, pa.array(item.score)]
                yield pa.RecordBatch.from_arrays(found, schema=schema)

    return run


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list]:
    """Rows (item_id, term, times) of whole items, about ``block_terms`` at a time."""
    source = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    schema = T.StructType([items.schema["item_id"], T.StructField("term", T.LongType())])
    terms = staged(source.mapInArrow(_item_terms, schema).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "items")
    count = -(-terms.count() // block_terms)
    for block in range(count):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == block).collect()  # about block_terms rows
        if rows:
            yield rows


def _prepare(rows: list, hashes: np.ndarray, df: np.ndarray, documents: int, words: int) -> Search:
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r["item_id"], {})[r["term"] & 0xFFFFFFFFFFFFFFFF] = r["times"]
    items = []
    for times in by_item.values():
        terms = np.searchsorted(hashes, np.array(sorted(times), np.uint64))
        weights = np.array([times[int(hashes[t])] * weight(int(df[t]), documents) for t in terms.tolist()], np.int64)
        telling = (weights > 0) & (df[terms] > 0)
        items.append((terms[telling], weights[telling]))
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(hashes))
    return Search(list(by_item), items, rank, documents, words)


def rank(documents: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) of the highest score for every item (item_id, text)."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = items.schema["item_id"]
    schema = T.StructType([key, T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    arrow = pa.schema([("item_id", to_arrow_type(key.dataType)), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = None
    for rows in _blocks(items, block_terms):
        hashes = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64))
        held = spark.sparkContext.broadcast(Vocabulary(hashes))
        vectors = staged(source.mapInArrow(_restrict(held), "doc_id long, n long, terms array<int>, tf array<long>").filter("n > 0"), "vectors")
        total = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
        if not total["documents"]:
            continue
        df = np.zeros(len(hashes), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms at most
            df[r["term"]] = r["count"]
        search = spark.sparkContext.broadcast(_prepare(rows, hashes, df, total["documents"], total["words"]))
        # the vectors are far smaller than the texts, so their files would make few and long tasks
        dealt = vectors.filter(F.size("terms") > 0).repartition(max(1, source.rdd.getNumPartitions()))
        best = dealt.mapInArrow(_search(search, k, shard_terms, arrow), schema)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def oracle(k: int = K) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS MATERIALIZED (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT r, doc_id, {terms} AS t FROM d) GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY r),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
m AS (SELECT r, {FLAT} + ({SHARE} * n * docs) // words AS m FROM n, a),
w AS (SELECT t, CAST(floor({WEIGHT} * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM t GROUP BY t), a),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {terms} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * (({FULL} * tf) // ({GROWTH} * tf + {LENGTH} * m))) AS BIGINT) AS score
  FROM i JOIN w USING (t) JOIN t USING (t) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s QUALIFY rank <= {k}"""
