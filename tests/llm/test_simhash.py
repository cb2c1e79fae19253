import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, simhash


def test_equals_plain_version(documents, texts, nothing):
    out = simhash.near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted(brute.simhash(texts), key=str)
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_row_stays_of_each_group(crowded, texts):
    kept = simhash.keep_one(crowded)
    assert kept.columns == crowded.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {}
    for (doc_id, text), (_, _, component) in zip(texts, brute.simhash(texts), strict=True):
        groups.setdefault(component, set()).add((doc_id, text))
    assert len(rows) == len(set(rows)) == len(groups)
    for component, members in groups.items():
        stays = [r for r in rows if r in members]
        assert len(stays) == 1 and stays[0][0] == component


@pytest.mark.parametrize("chunk", [8192, 7])
def test_links_of_clustered_codes(spark, chunk):
    random = np.random.default_rng(5)
    centres = random.integers(0, 1 << 62, 12, dtype=np.uint64)
    codes = set()
    for c in centres:
        for _ in range(40):
            flips = random.choice(64, random.integers(0, 6), replace=False)
            codes.add(int(np.bitwise_xor.reduce([c, *(np.uint64(1) << np.uint64(b) for b in flips)])))
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), chunk=chunk)
    got = {r.u: r.root for r in graph.components(links).collect()}
    want = brute.components(codes)
    same = lambda label: {frozenset(i for i, x in enumerate(label) if x == y) for y in set(label)}
    assert same([got.get(c, c) for c in signed]) == same(want)


def test_kernel_over_many_buckets():
    random = np.random.default_rng(7)
    base = random.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = np.concatenate([b ^ (np.uint64(1) << random.integers(0, 64, 20, dtype=np.uint64)) for b in base])
    buckets = np.sort(random.integers(0, 40, len(codes)))
    root = simhash.bucket_roots(codes, buckets, 2)
    for bucket in np.unique(buckets):
        at = np.flatnonzero(buckets == bucket)
        want = brute.components(codes[at])
        assert [int(root[a]) for a in at] == [int(at[w]) for w in want]


def test_components_of_long_paths_and_stars(frame):
    links = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(5, 5), (200, 201), (201, 200), (39, 100)]
    out = {r.u: r.root for r in graph.components(frame(links, "u long, v long")).collect()}
    assert out == {**dict.fromkeys([*range(40), *range(100, 161)], 0), 200: 200, 201: 200}
    assert graph.components(frame([], "u long, v long")).count() == 0
