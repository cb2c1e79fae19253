"""Whitening of embeddings over their distinct values.

An entry c of a vector becomes the whole number x = floor(64 * c) + 1,000,000. Rows with equal x vectors are
grouped, and each distinct one is worked on once: its weight in the fit is one, or the number of its rows.
The sums of all entries are exact whole numbers, so a centred vector is an exact whole number over the
total weight. Every task multiplies its centred vectors (a weighted matrix product), the products of all
tasks are added up in two levels, and the unit eigenvectors of the covariance whiten each distinct vector.
The results are joined back to the rows.

An x vector is moved as bytes of the smallest width that holds all its entries, so equal vectors have equal
bytes. Vectors that make up more than one in ``HOT_SHARE`` of the rows, of which there are fewer than that, are
known by a broadcast of their bytes and dealt over ``SALTS`` tasks when they are joined back.

Defined results: rows whose vector is null, or holds null or non-finite entries, or an entry whose x is not a
long, are dropped, and so are rows whose vector has not the most usual length (of equally usual ones the
longest); components without variance are left out, so one distinct vector, or vectors without entries, have
none; repeated rows each get their results; ``deviation`` is null where it is not a long; an empty table gives
an empty one. Other columns pass in a struct, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import lists
from tidemark.session import staged

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
HOT_SHARE, SALTS = 1000, 64
#: Numbers that a task multiplies at a time; variance below this share of the largest is none.
BLOCK_NUMBERS, NO_VARIANCE = 1 << 20, 1e-12
_LONG = np.iinfo(np.int64).max


def _levels(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(64 * c) of all usable vectors one after the other, their lengths, and which rows they are."""
    kind = vectors.type.value_type
    entries = vectors.flatten()  # leaves out null vectors
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_decimal(kind):
        entries = entries.cast(pa.float64())
    c = entries.fill_null(float("nan") if pa.types.is_floating(entries.type) else 0).to_numpy(zero_copy_only=False).astype(np.float64)
    c[entries.is_null().to_numpy(zero_copy_only=False)] = np.nan
    with np.errstate(over="ignore", invalid="ignore"):
        level = np.floor(SCALE * c)
        good = (level >= -(2.0**63)) & (level < 2.0**63 - 2 * SHIFT)  # false for nan
    owner = np.repeat(np.arange(len(vectors)), sizes)
    there &= np.bincount(owner[~good], minlength=len(vectors)) == 0
    return level[there[owner]].astype(np.int64), sizes[there], np.flatnonzero(there)


def pack(level: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The vectors as bytes: the width of an entry, and all entries."""
    ends = np.cumsum(sizes)
    out: list[bytes] = []
    widths = np.ones(len(level), np.int64)
    for width in (1, 2, 4):
        info = np.iinfo(f"i{width}")
        widths[(level < info.min) | (level > info.max)] = 2 * width
    full = sizes > 0
    width = np.ones(len(sizes), np.int64)
    if full.any():
        width[full] = np.maximum.reduceat(widths, (ends - sizes)[full])
    by_width = {w: level.astype(f"<i{w}").tobytes() for w in np.unique(width).tolist()}
    for start, end, w in zip((ends - sizes).tolist(), ends.tolist(), width.tolist(), strict=True):
        out.append(bytes([w]) + by_width[w][start * w : end * w])
    return out


def unpack(packed: pa.Array, size: int) -> np.ndarray:
    """x of vectors of ``size`` entries, a row each."""
    out = np.empty((len(packed), size), np.int64)
    raw = packed.to_pylist()
    widths = np.array([b[0] for b in raw], np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(raw[k][1:] for k in at.tolist()), f"<i{w}").reshape(len(at), size)
    return out + SHIFT


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:  # row, vector
        level, sizes, at = _levels(batch.column(1))
        salt = (seen + np.arange(len(at))) % SALTS
        seen += len(at)
        columns = [batch.column(0).take(pa.array(at)), pa.array(sizes), pa.array(pack(level, sizes), pa.binary()), pa.array(salt.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "size", "packed", "salt"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_NUMBERS // max(1, size))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


@dataclass
class Fit:
    """Exact sums of the fit: total weight, sums of the entries, largest absolute entry."""

    size: int
    total: int
    sums: list[int]
    largest: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """total * x - sums, exact: of Python's numbers where a long could not hold them."""
        if self.total * self.largest + max(map(abs, self.sums), default=0) < 2**62:
            return self.total * x - np.array(self.sums, np.int64)
        return self.total * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.total).astype(np.float64)

    def squares(self, x: np.ndarray) -> tuple[list[int | None], list[int]]:
        """The sum of squared deviations of each vector: as a long, and with all digits."""
        d = self.deviations(x)
        most = int(abs(d).max()) if d.size else 0
        if most * most * max(1, self.size) > _LONG:
            d = d.astype(object)
        exact = [int(v) for v in (d * d).sum(axis=1)]
        return [v if v <= _LONG else None for v in exact], exact


def _sum_up(size: int, by_rows: bool):
    """Per task: weight and, in 32-bit halves, the sums of all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, largest = 0, 0
        halves = np.zeros((2, size), object)
        for batch in _blocks(batches, size):
            x = unpack(batch.column(0), size)
            weight = batch.column(1).to_numpy() if by_rows else np.ones(len(x), np.int64)
            total += int(weight.sum())
            largest = max(largest, int(abs(x).max()) if x.size else 0)
            kind = np.int64 if largest * int(weight.sum()) < 2**62 else object
            sums = (weight[:, None].astype(kind) * x.astype(kind)).sum(axis=0).astype(object)
            halves[0] += sums & 0xFFFFFFFF
            halves[1] += sums >> 32
        columns = [pa.array([total]), pa.array([largest]), *(pa.array([[int(v) for v in half]], pa.list_(pa.int64())) for half in halves)]
        if total:
            yield pa.RecordBatch.from_arrays(columns, ["total", "largest", "low", "high"])

    return run


def _fit(distinct: DataFrame, size: int, by_rows: bool) -> Fit:
    parts = distinct.select("packed", "copies").mapInArrow(_sum_up(size, by_rows), "total long, largest long, low array<long>, high array<long>")
    wide = "decimal(38,0)"
    sums = parts.select(F.posexplode(F.arrays_zip("low", "high")).alias("at", "half")).groupBy("at")
    sums = sums.agg(F.sum(F.col("half.low").cast(wide)).alias("low"), F.sum(F.col("half.high").cast(wide)).alias("high"))
    found = {r["at"]: int(r["low"]) + (int(r["high"]) << 32) for r in sums.collect()}  # one row per dimension
    whole = parts.agg(F.sum("total").alias("total"), F.max("largest").alias("largest")).first()
    return Fit(size, whole["total"], [found[k] for k in range(size)], whole["largest"])


def _products(centre, size: int, by_rows: bool):
    """Per task: the weighted product of its centred vectors with themselves, and their weighted sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, sums = np.zeros((size, size)), np.zeros(size)
        for batch in _blocks(batches, size):
            c = centre(batch.column(0))
            weighted = c * batch.column(1).to_numpy()[:, None] if by_rows else c
            product += weighted.T @ c
            sums += weighted.sum(axis=0)
        yield _matrix(product, sums)

    return run


def _matrix(product: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([product.tobytes()]), pa.array([sums.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["part", "product", "sums"])


def _add(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, sums, some = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            for _, p, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                product += np.frombuffer(p).reshape(size, size)
                sums += np.frombuffer(s)
                some = True
        if some:
            yield _matrix(product, sums)

    return run


def _product(vectors: DataFrame, centre, size: int, by_rows: bool) -> tuple[np.ndarray, np.ndarray]:
    """The weighted product and sum over all tasks, added up in two levels; the driver gets one matrix."""
    schema = "part int, product binary, sums binary"
    parts = vectors.mapInArrow(_products(centre, size, by_rows), schema)
    for fan in (SALTS, 1):
        parts = parts.repartition(fan, "part").sortWithinPartitions("part").mapInArrow(_add(size), schema)
    for row in parts.collect():
        return np.frombuffer(row["product"]).reshape(size, size), np.frombuffer(row["sums"])
    return np.zeros((size, size)), np.zeros(size)


def _from_packed(fit: Fit):
    return lambda column: fit.centred(unpack(column, fit.size))


def _from_lists(mean: np.ndarray):
    return lambda column: column.flatten().to_numpy().reshape(len(column), len(mean)) - mean


@dataclass
class Model:
    fit: Fit
    matrix: np.ndarray  # a column for each component, over the root of its variance
    explained: np.ndarray


def components(covariance: np.ndarray, fit: Fit, most: int) -> Model:
    """Unit eigenvectors by falling variance; the largest entry of each is positive."""
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    keep = np.flatnonzero(value > NO_VARIANCE * max(value[:1].sum(), 0.0))[:most]
    keep = keep[value[keep] > 0]
    value, vector = value[keep], vector[:, keep]
    vector = vector * np.sign(vector[abs(vector).argmax(axis=0), np.arange(len(keep))]) if len(keep) else vector
    return Model(fit, vector / np.sqrt(value), value / np.trace(covariance))


def _whiten(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        size, count = model.matrix.shape
        for batch in _blocks(batches, size):
            x = unpack(batch.column(0), size)
            whitened = model.fit.centred(x) @ model.matrix
            deviation, exact = model.fit.squares(x)
            wide = pa.array([str(v) if v < 10**38 else None for v in exact], pa.string())
            offsets = np.arange(len(x) + 1) * count
            columns = [*batch.columns, pa.array(deviation, pa.int64()), wide, lists(offsets, whitened.ravel())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "deviation", "deviation_digits", "whitened"])

    return run


def whiten(vectors: DataFrame, column: str = "embedding", keep: list[str] | None = None, k: int = COMPONENTS, by_rows: bool = False) -> DataFrame:
    """The rows with a usable vector: ``row`` (the columns of ``keep``, default all), whitened values and figures of the fit.

    whitened (up to ``k`` components), explained (of each), n (total weight), deviation and
    deviation_digits (sum of squares of n * x - sums), copies (rows with the vector), identity_error.
    ``by_rows`` weighs a distinct vector by the number of its rows instead of one.
    """
    spark = vectors.sparkSession
    inner = F.struct(*[F.col(f"`{c}`") for c in (vectors.columns if keep is None else keep)]).alias("row")
    source = vectors.select(inner, F.col(f"`{column}`").alias("vector"))
    schema = T.StructType([source.schema["row"]]).add("size", "long").add("packed", "binary").add("salt", "integer")
    rows = source.mapInArrow(_pack, schema)
    distinct = staged(rows.groupBy("size", "packed").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    usual = distinct.groupBy("size").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    size, count = (usual["size"], usual["rows"]) if usual else (0, 0)
    distinct = distinct.filter(F.col("size") == size).select("packed", "copies")
    if count:
        fit = _fit(distinct, size, by_rows)
        product, _ = _product(distinct, _from_packed(fit), size, by_rows)
        model = components(product / fit.total, fit, k)
    else:
        fit = Fit(0, 0, [], 0)
        model = Model(fit, np.zeros((0, 0)), np.zeros(0))
    names = "packed binary, copies long, deviation long, deviation_digits string, whitened array<double>"
    done = staged(distinct.mapInArrow(_whiten(spark.sparkContext.broadcast(model)), names), "whitened")
    wide, error = len(model.explained), 0.0
    if wide:
        of = done.select("whitened", "copies")
        _, sums = _product(of, _from_lists(np.zeros(wide)), wide, by_rows)
        product, _ = _product(of, _from_lists(sums / fit.total), wide, by_rows)
        error = float(abs(product / fit.total - np.eye(wide)).max())
    hot = F.col("copies") * HOT_SHARE > count  # fewer than HOT_SHARE vectors
    known = F.broadcast(distinct.filter(hot).select("packed", F.lit(True).alias("hot")))
    dealt = rows.filter(F.col("size") == size).join(known, "packed", "left").withColumn("salt", F.when(F.col("hot"), F.col("salt")).otherwise(0))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    joined = dealt.select("row", "packed", "salt").join(done.withColumn("salt", F.explode(salts)), ["packed", "salt"])
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>").alias("explained")
    figures = [F.lit(fit.total).cast("long").alias("n"), "deviation", F.col("deviation_digits").cast("decimal(38,0)").alias("deviation_digits")]
    return joined.select("row", "whitened", explained, *figures, "copies", F.lit(error).alias("identity_error"))
