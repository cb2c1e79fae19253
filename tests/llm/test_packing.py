import brute
import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm.tokens import packed

PATH = P.path("word_bpe_49k.json")


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(by)


def test_pieces_and_places(documents, texts, nothing):
    rows = packing.pack(documents, PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(brute.pieces(texts, PATH), key=str)
    total = sum(r.length for r in rows)
    assert check(rows, 4096) <= -(-total // 4096) * 1.05 + 1
    small = packing.pack(documents, PATH, capacity=50).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in small), key=str) == sorted(brute.pieces(texts, PATH, 50), key=str)
    check(small, 50)
    assert packing.pack(nothing, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=31, max_size=31))
def test_plans_use_every_piece_once(counts):
    counts[0] = 0
    plan = packing.make_plan(np.array(counts))
    used = np.zeros(31, int)
    for times, pattern in plan:
        assert sum(pattern) <= 30 and times > 0
        for length in pattern:
            used[length] += times
    assert used.tolist() == counts
    assert len(plan) <= sum(1 + 30 // n for n in range(1, 31))
    table = packing.slots(plan)
    seen = set()
    for length, n in enumerate(counts):
        for rank in range(n):
            s = table[length][np.searchsorted(table[length][:, 0], rank, "right") - 1]
            at = (s[1] + (rank - s[0]) // s[2], s[3] + (rank - s[0]) % s[2] * length)
            seen.update((at[0], at[1] + k) for k in range(length))
    assert len(seen) == sum(n * c for n, c in enumerate(counts))


def test_exact_complements_come_first():
    counts = np.zeros(101, int)
    counts[[60, 40, 25, 15, 70, 10]] = [2, 1, 1, 1, 1, 3]
    assert packing.make_plan(counts) == [(1, [70, 10, 10, 10]), (1, [60, 40]), (1, [60, 25, 15])]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB'sßéÉ!?. \n\t12<|endoftext>ΣİǺ", max_size=60))
def test_ids_equal_the_tokenizer(text):
    tokenizer = packed(PATH)
    assert list(tokenizer.texts([text])) == [tokenizer.encode(text).tobytes()]


def test_memory_of_words_starts_anew(monkeypatch):
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    monkeypatch.setattr(tokens, "GROUP", 10)
    tokenizer = tokens.Packed(PATH)
    texts = [f"some words number{k} of {k % 7} texts" for k in range(50)]
    assert list(tokenizer.texts(texts)) == [tokenizer.encode(t).tobytes() for t in texts]
    assert len(tokenizer.held) + len(tokenizer.older) < 60
