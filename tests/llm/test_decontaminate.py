import brute
import pytest
from conftest import SF

from tidemark.llm import decontaminate as d

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
key = lambda rows: sorted(rows, key=str)


def found(marked):
    return key(tuple(r) for r in d.summary(marked).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def items(spark, texts):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = " ".join(texts[5][1].split()[3:60])
    return [*rows, (500, "no id"), (501, "word3"), (502, None), (503, "..."), (504, long), (504, long), (None, "Unicode"), (505, "here"), (506, texts[-2][1])]


@pytest.mark.parametrize("block_words", [d.BLOCK_WORDS, 40_000])
def test_equals_plain_version(frame, documents, texts, items, block_words):
    benchmark = frame(items, "item_id long, text string")
    assert found(d.contamination(documents, benchmark, block_words=block_words)) == key(brute.contamination(texts, items))


def test_empty_tables(frame, documents, nothing, items, texts):
    benchmark = frame(items, "item_id long, text string")
    assert found(d.contamination(nothing, benchmark)) == []
    assert found(d.contamination(documents, benchmark.limit(0))) == key(brute.contamination(texts, []))
    assert d.remove_contaminated(documents, benchmark.limit(0)).count() == len(texts)


def test_clean_documents_stay_with_all_columns(frame, crowded, texts, items):
    benchmark = frame(items, "item_id long, text string")
    kept = d.remove_contaminated(crowded, benchmark, block_words=40_000)
    assert kept.columns == crowded.columns
    clean = [t for t, r in zip(texts, brute.contamination(texts, items), strict=True) if not r[5]]
    assert key((r.doc_id, r.text) for r in kept.collect()) == key(clean) and 0 < len(clean) < len(texts)


def test_longest_matches(frame):
    words = [f"w{k}" for k in range(100)]
    docs = [(1, " ".join(words[5:40])), (2, "x " + " ".join(words[20:55])), (3, " ".join(words[:9])), (4, "y " + " ".join(words[5:40]))]
    out = d.longest_matches(frame(docs, "doc_id long, text string"), frame([("a", " ".join(words)), ("b", "none of it")], "item_id string, text string")).collect()
    assert sorted(tuple(r) for r in out) == [("a", 5, 1, 0, 35), ("a", 5, 4, 1, 35), ("a", 20, 2, 1, 35)]


def test_a_match_of_any_length_is_whole(frame):
    """A match of 5,000 words over several segments, one that crosses the end of a segment, and a repeat of its middle."""
    item = [f"w{k}" for k in range(7000)]
    docs = [(1, "a b " + " ".join(item[1000:6000]) + " c"), (2, " ".join(item[1990:2010])), (3, " ".join(item[1000:3000]) + " gap " + " ".join(item[3000:6000])), (3, "other text " + " ".join(item[10:40]))]
    out = d.longest_matches(frame(docs, "doc_id long, text string"), frame([("long", " ".join(item)), ("part", " ".join(item[1995:2300]))], "item_id string, text string")).collect()
    assert sorted(tuple(r) for r in out) == [("long", 1000, 1, 2, 5000), ("part", 0, 1, 997, 305), ("part", 0, 3, 995, 305)]


@pytest.mark.parametrize("window", [3, 5])
def test_longest_matches_of_short_windows(frame, window):
    import numpy as np

    random = np.random.default_rng(window)
    text = lambda n: [f"w{x}" for x in random.integers(0, 6, n)]
    docs, items = [(k, text(40)) for k in range(25)], [(f"i{k}", text(30)) for k in range(6)]
    want = []
    for name, item in items:
        runs = []
        for doc_id, words in docs:
            for i in range(len(item)):
                for j in range(len(words)):
                    if i and j and item[i - 1] == words[j - 1]:
                        continue
                    n = next((n for n in range(min(len(item) - i, len(words) - j)) if item[i + n] != words[j + n]), min(len(item) - i, len(words) - j))
                    if n >= window:
                        runs.append((name, i, doc_id, j, n))
        want += [r for r in runs if r[4] == max(x[4] for x in runs)]
    df = lambda rows, key: frame([(k, " ".join(w)) for k, w in rows], f"{key}, text string")
    out = d.longest_matches(df(docs, "doc_id long"), df(items, "item_id string"), window=window).collect()
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_suffix_array_is_sorted():
    import numpy as np

    words = np.concatenate([np.random.default_rng(1).integers(0, 3, 400), np.zeros(60, np.int64)])
    at = np.flatnonzero(words)
    order = d.suffix_array(words, at, 50)
    stop = lambda p: next(k for k in range(50) if words[p + k] == 0 or k == 49)
    suffixes = [tuple(words[p : p + stop(p)]) for p in order]
    assert sorted(order.tolist()) == at.tolist() and suffixes == sorted(suffixes)
