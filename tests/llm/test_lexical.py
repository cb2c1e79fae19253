import math
import re
from collections import Counter

import numpy as np
import pytest
from brute import LOWER
from conftest import SF

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(documents, items, k=20):
    docs = [(doc_id, Counter(cut(t))) for doc_id, t in documents]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, words = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    by_item = {}
    for item, text in dict.fromkeys(items):
        by_item.setdefault(item, Counter()).update(cut(text))
    out = []
    for item, terms in by_item.items():
        found = []
        for doc_id, c, n in docs:
            m = 75 + 25 * n * total // words
            score = 0
            for t, times in terms.items():
                if t in c:
                    score += times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    twice = rows[2][1]
    return [*rows, rows[0], (700, twice), (700, rows[3][1]), (701, None), (702, "..."), (703, "zzzz qqqq"), (704, "the THE the"), (None, twice), (705, "日本語 straße")]


@pytest.mark.parametrize("shard, block", [(lexical.SHARD_TERMS, lexical.BLOCK_TERMS), (500, 40), (1, lexical.BLOCK_TERMS)])
def test_equals_plain_version(frame, documents, texts, items, shard, block):
    out = lexical.rank(documents, frame(items, "item_id long, text string"), block_terms=block, shard_terms=shard)
    assert got(out) == plain(texts, items)
    assert {r[0] for r in got(out)} >= {700, None, 704}


def test_many_copies_and_ties(frame):
    """A third of the rows are one text, and far more than k documents have the same score."""
    random = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in random.zipf(1.4, 30) if x < 500)) for k in range(900)]
    rows += [(2000 - k, "w1 w2 w7 w400 same text") for k in range(450)] + [(None, "w1 w2 w7 w400 same text")]
    items = [(f"i{k}", " ".join(f"w{x}" for x in random.zipf(1.3, 12) if x < 500)) for k in range(25)] + [("same", "text w400 w7")]
    out = lexical.rank(frame(rows, SCHEMA).repartition(3), frame(items, "item_id string, text string"), k=7, shard_terms=1500)
    assert got(out) == plain(rows, items, 7)


def test_subtrees_are_left_out():
    """The search looks at a small part of the documents where one stands out, and its bounds hold."""
    random = np.random.default_rng(9)
    sizes = random.integers(1, 12, 4000)
    owner = np.repeat(np.arange(4000), sizes)
    pair = np.unique(owner * 300 + np.minimum(random.zipf(1.3, len(owner)), 300) - 1)
    owner, rank = pair // 300, pair % 300
    sizes = np.bincount(owner, minlength=4000)
    tf, m = random.integers(1, 9, len(rank)), random.integers(76, 400, 4000)
    tree = lexical.Tree(np.arange(4000), np.zeros(4000, bool), m, sizes, rank, tf)
    looked = []
    inner = tree.scores
    tree.scores = lambda *a: (looked.append(len((found := inner(*a))[0])), found)[1]
    ranks, weights = np.array([0, 1, 40, 200]), np.array([3, 40, 3000, 7000])
    item = lexical.Item(ranks, weights)
    tree.search(item, ranks, 5)
    value = np.zeros(4000, np.int64)
    for r, w in zip(ranks, weights):
        at = rank == r
        np.add.at(value, owner[at], w * lexical.part(tf[at], m[owner[at]]))
    want = np.lexsort((np.arange(4000), -value))[:5]
    assert item.doc.tolist() == want.tolist() and item.score.tolist() == value[want].tolist()
    assert sum(looked) < 0.5 * (value > 0).sum()


def test_bounds_do_not_fall_below_scores():
    random = np.random.default_rng(1)
    tf, m = random.integers(1, 50, 1000), random.integers(75, 5000, 1000)
    assert (lexical.part(np.maximum(tf, tf[::-1]), np.minimum(m, m[::-1])) >= lexical.part(tf, m)).all()
    large = lexical.measure(np.array([1 << 40, 3]), 1 << 30, 1 << 41)
    assert large.tolist() == [75 + 25 * (1 << 70) // (1 << 41), 75 + 25 * 3 * (1 << 30) // (1 << 41)]


def test_columns_that_clash_and_empty_tables(frame, crowded, texts, nothing, items):
    few = items[:3]
    assert got(lexical.rank(crowded, frame([(i, "x", t) for i, t in few], "item_id long, terms string, text string"))) == plain(texts, few)
    assert lexical.rank(nothing, frame(few, "item_id long, text string")).count() == 0
    empty = lexical.rank(crowded, frame([], "item_id string, text string"))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
