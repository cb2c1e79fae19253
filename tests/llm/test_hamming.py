import numpy as np
import pytest

from tidemark.llm import hamming


def vectors(frame, rows):
    return frame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [hamming.BLOCK_CODES, 3])
def test_equals_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(hamming, "CANDIDATES", 200)
    random = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in random.normal(size=64)]) for k in range(400)]
    rows += [(1000 + k, rows[10][1]) for k in range(60)]  # a hot code
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 64), (2003, [None, 1.0] * 10)]
    code = {k: sum(1 << b for b, x in enumerate(v) if x is not None and x > 0) for k, v in rows if v is not None}
    df = vectors(frame, rows)
    out = hamming.top_k(df, df.filter("vec_id % 50 = 0"), k=7, block_codes=block).collect()
    want = []
    for q in code:
        if q % 50 == 0:
            near = sorted(((code[q] ^ c).bit_count(), k) for k, c in code.items() if k != q)[:7]
            want += [(q, n + 1, k, dist) for n, (dist, k) in enumerate(near)]
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_few_rows(frame):
    df = vectors(frame, [(0, [1.0] * 64), (1, [-1.0] * 64)])
    assert [tuple(r) for r in hamming.top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 64)]
    assert hamming.top_k(df.limit(0), df).count() == 0
    assert hamming.top_k(df, df.limit(0)).count() == 0


def test_longer_vectors_and_columns_that_clash(frame):
    rows = [(k, "x", k, [float((k >> b & 1) * 2 - 1) for b in range(8)] * (9 if k == 3 else 8)) for k in range(20)]
    df = frame(rows, "vec_id long, code string, distance int, embedding array<double>")
    out = hamming.top_k(df, df.filter("vec_id IN (0, 3)"), k=5).collect()
    assert {r.query_id for r in out} == {0} and 3 not in {r.neighbour_id for r in out} and len(out) == 5


def test_ids_with_many_vectors(frame, monkeypatch):
    monkeypatch.setattr(hamming, "SHARD_ROWS", 64)
    random = np.random.default_rng(3)
    base = random.normal(size=64)
    near = lambda: [float(x) for x in np.where(random.random(64) < 0.1, -base, base)]
    rows = [(0, near()) for _ in range(40)] + [(7, near()) for _ in range(60)] + [(9, near()) for _ in range(5)]
    rows += [(100 + k, [float(x) for x in random.normal(size=64)]) for k in range(50)]
    df = vectors(frame, rows)
    out = hamming.top_k(df, df.filter("vec_id % 50 = 0"), k=7).collect()
    code = [(k, sum(1 << b for b, x in enumerate(v) if x > 0)) for k, v in rows]
    want = []
    for query in (0, 100):
        least = {}
        for k, c in code:
            if k != query:
                least[k] = min(least.get(k, 64), *((c ^ own).bit_count() for q, own in code if q == query), 64)
        want += [(query, n + 1, k, d) for n, (d, k) in enumerate(sorted((d, k) for k, d in least.items())[:7])]
    assert sorted(tuple(r) for r in out) == sorted(want)
