import math

import numpy as np
import pytest

from tidemark.llm import queries, whitening

CLASH = ["row", "size", "packed", "salt", "copies", "whitened", "n", "hot"]


def plain(vectors, weigh=False):
    """x of each usable row, and by x: whitened values; explained, deviation, identity error."""
    usable = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) if v and all(c is not None and math.isfinite(c) for c in v) else None for v in vectors]
    distinct = sorted(set(x for x in usable if x))
    w = np.array([usable.count(x) if weigh else 1 for x in distinct])
    n, s = int(w.sum()), [sum(int(k) * x[d] for k, x in zip(w, distinct)) for d in range(len(distinct[0]))]
    centred = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in distinct])
    v = (centred * w[:, None]).T @ centred / n
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)[:16]
    whitened = centred @ vector[:, order] / np.sqrt(value[order])
    deviation = [sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in distinct]
    return usable, n, {x: (whitened[k], deviation[k]) for k, x in enumerate(distinct)}, value[order] / np.trace(v)


def same(rows, vectors, weigh=False):
    usable, n, by_x, explained = plain(vectors, weigh)
    assert sorted(r.row.at for r in rows) == [k for k, x in enumerate(usable) if x]
    got = np.array([r.whitened for r in rows])
    want = np.array([by_x[usable[r.row.at]][0] for r in rows])
    sign = np.sign((got * want).sum(axis=0))
    np.testing.assert_allclose(got, want * sign, rtol=1e-6, atol=1e-7)
    for r in rows:
        assert (r.n, r.deviation, r.copies) == (n, by_x[usable[r.row.at]][1], usable.count(usable[r.row.at]))
        assert int(r.deviation_digits) == r.deviation and r.identity_error < 1e-9
        np.testing.assert_allclose(r.explained, explained, rtol=1e-9)


@pytest.fixture(scope="module")
def vectors():
    """2,000 vectors of 20 entries; a third of the rows hold the same, some entries are large, some rows unusable."""
    random = np.random.default_rng(4)
    mixed = random.normal(size=(2000, 20)) @ random.normal(size=(20, 20)) * np.linspace(0.01, 30, 20)
    mixed[:, 3] *= 100
    mixed[::3] = mixed[0]
    mixed[5::7] = np.round(mixed[5::7])
    rows = [tuple(float(c) for c in v) for v in mixed]
    odd = [None, [], [None] * 20, [math.nan] * 20, [math.inf] + [0.0] * 19, [1e300] * 20, [0.5] * 3, [-0.0] * 20, [0.0] * 20]
    return rows + odd


@pytest.mark.parametrize("weigh", [False, True])
def test_equals_plain_version(frame, vectors, weigh):
    df = frame([(k, v) for k, v in enumerate(vectors)], "at long, embedding array<double>").repartition(5)
    usable = [v if v and len(v) == 20 and max(abs(c or 0) for c in v) < 1e100 else None for v in vectors]
    same(whitening.whiten(df, by_rows=weigh).collect(), usable, weigh)


def test_whitened_values_are_uncorrelated(spark):
    out = queries.QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert wide.shape[1] == 16
    np.testing.assert_allclose(wide.T @ wide / len(wide), np.eye(16), atol=1e-9)  # its vectors are distinct
    assert (np.diff(out[out.vec_id == 0].sort_values("component").explained) <= 0).all() and out.identity_error.nunique() == 1


def test_columns_that_clash_and_repeated_rows(frame, vectors):
    fields = ", ".join(f"{c} string" for c in CLASH)
    rows = [(k, *[str(k)] * len(CLASH), v) for k, v in enumerate(vectors[:100])]
    df = frame(rows + rows[:10], f"at long, {fields}, embedding array<double>")
    out = whitening.whiten(df)
    assert out.schema["row"].dataType == df.schema and out.count() == 110
    assert {r.row.packed == str(r.row.at) for r in out.collect()} == {True}


def test_without_variance(frame):
    schema = "at long, embedding array<float>"
    assert whitening.whiten(frame([], schema)).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 0.25])] * 3 + [(None, [0.5, 0.25])], schema)).collect()
    assert len(one) == 4 and all(r.whitened == [] and r.deviation == 0 and (r.n, r.copies) == (1, 4) for r in one)
    assert [r.whitened for r in whitening.whiten(frame([(1, []), (2, None)], schema)).collect()] == [[]]
    flat = whitening.whiten(frame([(k, [k / 64, 3.0, -k / 64]) for k in range(5)], schema)).collect()
    assert all(len(r.whitened) == 1 and math.isclose(r.explained[0], 1) for r in flat)


def test_entries_of_any_size_are_exact(frame):
    """Sums and deviations beyond a long: the digits are exact, the long is null."""
    values = [[2.0**40, 1.0], [-(2.0**40), 2.0], [2.0**50, -7.0]]
    usable, n, by_x, _ = plain(values)
    out = whitening.whiten(frame(list(enumerate(values)), "at long, embedding array<double>")).collect()
    assert {int(r.deviation_digits) for r in out} == {d for _, d in by_x.values()} and {r.deviation for r in out} == {None}


def test_packing_round_trip():
    level = np.array([1, -128, 127, 128, -(1 << 15), 5, 1 << 31, 0, 0], np.int64)
    sizes = np.array([3, 2, 0, 1, 1, 2])
    packed = whitening.pack(level, sizes)
    assert [len(p) for p in packed] == [4, 5, 1, 2, 9, 3]
    import pyarrow as pa

    assert (whitening.unpack(pa.array(packed[1:2]), 2) == level[3:5] + 1_000_000).all()
