import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings as s

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.fixture(scope="module")
def planted(texts):
    random = np.random.default_rng(4)
    noise = lambda n: "".join(random.choice(list("abcdefgh ij"), n))
    shared, half = noise(460), noise(199)
    rows = [(2000 + k, noise(150) + shared + noise(90)) for k in range(6)]
    rows += [(2100, noise(50) + shared[100:330] + noise(5)), (2101, shared[:199] + noise(100)), (2102, half + noise(30)), (2103, noise(30) + half)]
    rows += [(2104, noise(40) + shared[7:300] + noise(60) + shared[7:300]), (2105, "ab" * 400), (2106, "é" * 300), (2107, "ö" + "é" * 300), (2108, "x" * 199)]
    return [*texts, *rows]


@pytest.mark.parametrize("most", [s.MOST, 1])
def test_equals_plain_version(frame, planted, most):
    out = s.report(frame(planted, "doc_id long, text string"), most=most).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted(brute.repeated(planted), key=str)


def first_kept(rows, size=200):
    """Later copies go; rows equal in id and text are one document."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                gone[k : k + size] = True
            seen.add(raw[k : k + size])
        out[doc_id, text] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("most", [s.MOST, 1])
def test_first_copy_stays(frame, planted, most):
    # equal ids with other texts have no order that the plain version knows
    rows = [r for r in planted if r[0] is not None]
    want = first_kept(rows)
    docs = frame(rows, "doc_id long, text string")
    got = s.report(docs, keep_first=True, most=most).collect()
    size = {k[0]: (len((k[1] or "").encode()), len(v)) for k, v in want.items()}
    assert {r.doc_id: (r.n_bytes, r.n_bytes - r.n_removed) for r in got} == size and len(got) == len(rows)
    kept = {r.doc_id: r.text for r in s.cut(docs, most=most).collect()}
    for (doc_id, text), raw in want.items():
        if raw or not text:
            assert kept[doc_id].encode() == raw or "é" in text
        else:
            assert doc_id not in kept


def test_columns_pass_and_empty_tables(crowded, nothing):
    out = s.cut(crowded)
    assert out.columns == crowded.columns and 0 < out.count() <= crowded.count()
    assert out.filter(F.col("doc_id") == 900).first().text == ""
    assert s.report(nothing).count() == 0 and s.cut(nothing).count() == 0


def test_window_ranks():
    random = np.random.default_rng(1)
    raw = random.integers(97, 99, 3000).astype(np.uint8)
    raw[1500:2500] = raw[200:1200]
    starts = np.arange(0, 2700)
    rank = s.window_ranks(raw, starts)
    strings = [raw[k : k + 200].tobytes() for k in starts]
    order = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert rank.tolist() == [order[x] for x in strings]


def test_anchors_cover_and_agree():
    random = np.random.default_rng(3)
    raw = random.integers(97, 100, 5000).astype(np.uint8)
    raw[3000:3400] = raw[1000:1400]
    offsets = np.array([0, 0, 2000, 2100, 5000])
    _, place, first, last = s.anchors(raw, offsets)
    at = {k: p - k for p, a, b in zip(place, first, last, strict=True) for k in range(a, b + 1)}
    inside = [k for a, b in zip(offsets, offsets[1:], strict=False) for k in range(a, b - 199)]
    assert sorted(at) == inside and all(0 <= x <= 168 for x in at.values())
    assert all(at[k] == at[k + 2000] for k in range(1000, 1201) if k in at and k + 2000 in at)
