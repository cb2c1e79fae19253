"""Exact searches that leave most of the table aside: token sets by an inverted index, vectors by pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import text as t
from tidemark.operators.ranking import first_per_key
from tidemark.session import staged

# ---- token sets ----------------------------------------------------------------------------


def _scored(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, page_id, score) of pairs, from both sets."""
    both = pairs.join(asked.select("query_id", F.col("set").alias("q")), "query_id").join(held.select("page_id", F.col("set").alias("p")), "page_id")
    common = F.size(F.array_intersect("q", "p"))
    return both.select("query_id", "page_id", F.round(common / (F.size("q") + F.size("p") - common), 9).alias("score"))


def postings_of(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """(org, token, page_id, p_size): the tokens of pages that a query of their organisation has."""
    held = pages.select("org", "page_id", F.size("set").alias("p_size"), F.explode("set").alias("token"))
    return held.join(queries.select("org", F.explode("set").alias("token")).distinct(), ["org", "token"], "left_semi")


def retrieve(queries: DataFrame, pages: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` pages of the query's organisation by Jaccard score of token sets, ties by page.

    ``queries``: query_id, org, query. ``pages``: page_id, org, text. Pages without a common token
    do not count. Tokens travel as 64-bit hashes.

    Pages are looked up in an inverted index by organisation and token. The tokens of a query are taken by rising
    frequency: the first ones, up to some ``k`` pages, give a k-th best score s. A better page shares
    s of the query's tokens at least, hence one of the first that are left when so many are taken away from the end, and its
    number of tokens is between s times the query's and that over s; only those are scored.
    """
    hashes = lambda text: F.transform(t.token_set(F.col(text)), lambda w: F.xxhash64(w))
    asked = queries.select("query_id", "org", F.array_distinct(hashes("query")).alias("set")).where(F.size("set") > 0)
    held = pages.select("page_id", "org", F.array_distinct(hashes("text")).alias("set"))
    postings = postings_of(asked, held)
    frequency = postings.groupBy("org", "token").agg(F.count(F.lit(1)).alias("pages"))
    tokens = asked.select("query_id", "org", F.size("set").alias("q_size"), F.explode("set").alias("token")).join(frequency, ["org", "token"])
    rising = W.partitionBy("query_id").orderBy("pages", "token")
    before = F.coalesce(F.sum("pages").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tokens = tokens.withColumn("rank", F.row_number().over(rising)).withColumn("before", before)
    tokens = tokens.withColumn("known", F.count(F.lit(1)).over(W.partitionBy("query_id")))
    first = tokens.where(F.col("before") < 2 * k).join(postings, ["org", "token"]).select("query_id", "page_id").distinct()
    seeds = _scored(first, asked, held)
    best = first_per_key(seeds, ["query_id"], F.desc("score"), F.asc("page_id"), n=k)
    least = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    near = F.coalesce("least", F.lit(0.0)) - 2e-9  # scores are rounded
    needed = F.greatest(F.ceil(near * F.col("q_size")), F.lit(1))
    prefix = tokens.join(least, "query_id", "left").where(F.col("rank") <= F.col("known") - needed + 1)
    fits = (F.col("p_size") >= near * F.col("q_size")) & (F.col("p_size") * near <= F.col("q_size"))
    more = prefix.join(postings, ["org", "token"]).where(fits).select("query_id", "page_id").distinct()
    rest = _scored(more.join(seeds, ["query_id", "page_id"], "left_anti"), asked, held)
    return first_per_key(seeds.unionByName(rest), ["query_id"], F.desc("score"), F.asc("page_id"), n=k)


# ---- vectors -------------------------------------------------------------------------------

#: Items that stand for the table, items of a cluster that meet the queries at once.
PIVOTS, CHUNK = 64, 20_000
#: Rows that a task works on at once besides a chunk of items.
SLICE = 1024
Matrix = Callable[[pa.Array], np.ndarray]


def dense(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def sparse(dimensions: int) -> Matrix:
    """Lists of whole numbers ``weight * dimensions + index`` as rows of that many dimensions, of length one."""

    def matrix(vectors: pa.Array) -> np.ndarray:
        out = np.zeros((len(vectors), dimensions))
        entries = vectors.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(vectors.offsets.to_numpy())
        out[np.repeat(np.arange(len(vectors)), sizes), entries % dimensions] = entries // dimensions
        norms = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]  # whole numbers: exact in any order
        out /= np.where(norms > 0, norms, 1)  # in its place: a chunk of items is the largest thing that a task holds
        return out

    return matrix


@dataclass
class Clusters:
    """Items by their nearest pivot: how far the farthest is, as an angle, and how long they are."""

    pivots: np.ndarray  # unit vectors
    number: np.ndarray  # of the cluster
    radius: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    items: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cluster a number that no product with an item of the cluster exceeds.

        An item is not nearer to the query than the pivot's angle less the radius (triangle inequality).
        """
        norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        angle = angles(queries, self.pivots[self.number])
        cosine = np.cos(np.maximum(angle - self.radius - 1e-6, 0))
        return norms * cosine * np.where(cosine > 0, self.longest, self.shortest) + 1e-9 * norms * self.longest

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """The most promising clusters of each query that hold ``k`` items."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.items[order], axis=1) - self.items[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.arccos(np.clip(vectors @ pivots.T / np.where(norms > 0, norms, 1), -1, 1))


def _assign(held: Broadcast, matrix: Matrix, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    near, size = angles, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:  # item, vector
            for at in range(0, len(whole), size):
                batch = whole.slice(at, size)
                rows = matrix(batch.column(1))
                angle = near(rows, held.value)
                cluster = angle.argmin(axis=1)
                norm = np.sqrt((rows * rows).sum(axis=1))
                angle = np.where(norm > 0, angle[np.arange(len(rows)), cluster], 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(angle), pa.array(norm)], schema=schema)

    return run


def _visits(held: Broadcast, matrix: Matrix, k: int, later: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The clusters that queries (query, vector, least) go to: first the most promising, later all others in reach of ``least``."""

    size = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = held.value
        step = max(1, 8 * size // len(clusters.number))  # a query may go to every cluster
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                bounds = clusters.bounds(matrix(part.column(1)))
                chosen = clusters.first(bounds, k)
                if later:
                    least = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    chosen = ~chosen & (bounds >= least[:, None] - 2e-9)  # scores are rounded
                row, which = np.nonzero(chosen)
                taken = [part.column(j).take(pa.array(row)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(clusters.number[which].astype(np.int32))], schema=schema)

    return run


def _products(matrix: Matrix, k: int, shared: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best items of a chunk for each query that comes to it: rows are sorted by chunk, items before queries."""
    size = SLICE

    def best(items: pa.RecordBatch, asked: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        q = matrix(asked.column("vector"))
        scores = np.round(q @ rows.T, 9)
        if shared:
            nonzero = (q != 0).astype(np.float32)
            for at in range(0, len(rows), size):
                common = nonzero @ (rows[at : at + size] != 0).astype(np.float32).T
                scores[:, at : at + size][common == 0] = np.nan
        top = np.argsort(np.where(np.isnan(scores), np.inf, -scores), axis=1, kind="stable")[:, :k]
        query = np.repeat(np.arange(len(asked)), top.shape[1])
        value = np.take_along_axis(scores, top, axis=1).ravel()
        keep = ~np.isnan(value)
        columns = [asked.column("query").take(pa.array(query[keep])), items.column("item").take(pa.array(top.ravel()[keep])), pa.array(value[keep])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, items, rows = None, [], None, None
        for batch in batches:  # cluster, chunk, asks, item, query, vector
            marks = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(3)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), len(batch)] if len(batch) else []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                now, asks, part = tuple(marks[:2, low]), marks[2, low], batch.slice(low, high - low)
                if now != key:
                    key, held, items, rows = now, [], None, None
                if not asks:
                    held.append(part)
                    continue
                if held:
                    items = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    rows, held = matrix(items.column("vector")), []
                if items is not None:
                    for at in range(0, len(part), 256):
                        yield best(items, part.slice(at, 256), rows)

    return run


def vector_top_k(
    queries: DataFrame,
    items: DataFrame,
    query: str,
    item: str,
    vector: str,
    k: int,
    matrix: Matrix = dense,
    shared: bool = False,
    pivots: int = PIVOTS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(query, item, score): exact top ``k`` items per query by dot product, rounded to 9 places; ties by item.

    Items are put to the nearest of some pivots. A query goes to its most promising clusters first, and then to those
    whose bound reaches its k-th score so far. An item travels once in each of the two rounds, whatever the number
    of queries: the queries of a chunk of its cluster stream past it. ``shared``: only items with a common nonzero entry count.
    """
    spark = items.sparkSession
    asked = queries.select(F.col(query).alias("query"), F.col(vector).alias("vector")).where("vector IS NOT NULL")
    held = items.select(F.col(item).alias("item"), F.col(vector).alias("vector")).where("vector IS NOT NULL")
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("score", T.DoubleType())])
    sample = held.orderBy(F.xxhash64("item")).limit(pivots).select("vector").toArrow().column("vector").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], schema)
    chosen = matrix(sample if isinstance(sample, pa.Array) else sample.chunk(0))
    norms = np.sqrt((chosen * chosen).sum(axis=1, keepdims=True))
    chosen = chosen / np.where(norms > 0, norms, 1)
    near = T.StructType([*held.schema.fields, *T.StructType.fromDDL("cluster int, angle double, norm double").fields])
    placed = staged(held.mapInArrow(_assign(spark.sparkContext.broadcast(chosen), matrix, to_arrow_schema(near)), near), "placed")
    figures = placed.groupBy("cluster").agg(F.max("angle"), F.max("norm"), F.min("norm"), F.count(F.lit(1)))
    found = np.array(sorted(tuple(r) for r in figures.collect()), float)  # a row per pivot at most
    clusters = Clusters(chosen, found[:, 0].astype(np.int64), *(found[:, j] for j in (1, 2, 3)), found[:, 4].astype(np.int64))
    model = spark.sparkContext.broadcast(clusters)
    sizes = {int(c): -(-int(n) // chunk) for c, n in zip(clusters.number, clusters.items, strict=True)}
    chunks = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(n))])[F.col("cluster")]

    def search(least: DataFrame | None) -> DataFrame:
        none = F.lit(None).cast("double").alias("least")
        source = asked.select("query", "vector", none) if least is None else asked.join(least, "query", "left").select("query", "vector", "least")
        going = T.StructType([*asked.schema.fields, T.StructField("cluster", T.IntegerType())])
        visits = source.mapInArrow(_visits(model, matrix, k, least is not None, to_arrow_schema(going)), going)
        visits = visits.select("cluster", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("asks"), "query", "vector")
        own = F.pmod(F.xxhash64("item"), chunks).cast("int").alias("chunk")
        both = placed.select("cluster", own, F.lit(0).alias("asks"), "item", "vector").unionByName(visits, allowMissingColumns=True)
        both = both.select("cluster", "chunk", "asks", "item", "query", "vector")
        dealt = both.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "asks", "item")
        best = dealt.mapInArrow(_products(matrix, k, shared, to_arrow_schema(schema)), schema)
        return first_per_key(best, [query], F.desc("score"), F.asc(item), n=k)

    seeds = staged(search(None), "seeds")
    least = seeds.groupBy(F.col(query).alias("query")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    rest = search(least.where(F.col("n") == k).drop("n"))
    return first_per_key(seeds.unionByName(rest), [query], F.desc("score"), F.asc(item), n=k)
