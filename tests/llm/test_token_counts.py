import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_counts as tc

RANKS = P.path("byte_bpe_50k.tiktoken")
count = tc.counter(RANKS, P.PATTERN)
words = st.text(alphabet="ab 'sre\n1.é", max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=60), st.data())
def test_edited_counts_equal_counting_again(parts, data):
    old, tc.LEAF = tc.LEAF, 3
    try:
        text = "".join(parts)
        tree = tc.plant(text, count)
        assert tree.total == len(count.encoding.encode_ordinary(text))
        for _ in range(2):  # edits of edits
            cuts = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=8)))
            edits = [(a, b, data.draw(words)) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
            new, _ = tc.apply(tree, text, edits, count)
            assert new == tc.edited(text, edits)
            assert (tree.total, tree.chars[1]) == (len(count.encoding.encode_ordinary(new)), len(new))
            text = new
    finally:
        tc.LEAF = old


def test_only_a_neighbourhood_is_encoded_again():
    text = "some words of a long text. " * 4000
    tree = tc.plant(text, count)
    new, again = tc.apply(tree, text, [(50_000, 50_004, "other"), (90_000, 90_000, " more")], count)
    assert tree.total == len(count.encoding.encode_ordinary(new)) and again < 3000


def test_tables(documents, texts, nothing, frame):
    trees = tc.build(documents, RANKS, P.PATTERN)
    want = sorted((str(k), len(count.encoding.encode_ordinary(t or ""))) for k, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens) for r in trees.select("doc_id", "n_tokens").collect()) == want
    after = tc.apply_edits(tc.with_redactions(trees, "[aeiou]n", "N!"), RANKS, P.PATTERN).collect()
    assert all(r.n_tokens == len(count.encoding.encode_ordinary(r.text)) for r in after) and sum(r.n_edits for r in after) > 1000
    assert tc.apply_edits(tc.with_redactions(tc.build(nothing, RANKS, P.PATTERN)), RANKS, P.PATTERN).count() == 0


def test_edits_that_overlap_fail():
    with pytest.raises(ValueError):
        tc.edited("abcdef", [(0, 3, ""), (2, 4, "")])
