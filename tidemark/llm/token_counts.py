"""Token counts that follow edits: a segment tree of pre-tokens per document.

A pre-token is what the tokenizer's pattern cuts from a text; tokens never reach over its ends. The
leaves of a document's tree are runs of ``LEAF`` pre-tokens with their number of characters and of
tokens, inner nodes hold sums. An edit descends to the leaf before it, cuts the new text again from
that leaf's start until a cut falls on the end of an old leaf, counts only those pre-tokens, and
updates the sums above them. Two characters of context to the left are enough: whether the pattern
ends a pre-token depends on at most two characters after its end.

Trees are columns (``tree_chars``, ``tree_tokens``: the leaves), so they can be stored and edited
again. Everything is a map over rows.

Defined results: a null text is empty and has no tokens; edits of a row are sorted by start, and
must not overlap or leave the text, else the row's edit fails with a ValueError; null edits are
none; repeated rows are counted each; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 64
#: Pre-tokens whose counts are held in a task.
MOST_HELD = 300_000
#: Fixed: what the redaction edits look for.
PERSONAL = (
    r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    r"|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\+?[0-9][0-9 ()-]{7,16}[0-9]\b|\b[0-9a-f]{32,}\b|\bAKIA[0-9A-Z]{16}\b"
)

EDITS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("replacement", T.StringType())])
)


class Counter(dict):
    """Pre-token -> its number of tokens."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as ranks:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __missing__(self, piece: str) -> int:
        count = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= MOST_HELD:
                self.clear()
            self[piece] = count
        return count


@functools.cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Sums of characters and tokens over leaves; node k has the children 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = max(1, len(chars))
        self.width = 1 << (self.leaves - 1).bit_length()
        pad = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def columns(self) -> tuple[list[int], list[int]]:
        ends = self.width + self.leaves
        return self.chars[self.width : ends], self.tokens[self.width : ends]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character, and where it starts; the last leaf for the end of the text."""
        if position >= self.chars[1]:
            last = self.leaves - 1
            return last, self.chars[1] - self.chars[self.width + last]
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if position - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def put(self, first: int, values: list[tuple[int, int]]) -> None:
        """New (characters, tokens) of leaves from ``first`` on."""
        for k, (chars, tokens) in enumerate(values, self.width + first):
            self.chars[k], self.tokens[k] = chars, tokens
        low, high = (self.width + first) // 2, (self.width + first + len(values) - 1) // 2
        while low:
            for k in range(low, high + 1):
                self._sum(k)
            low, high = low // 2, high // 2


def plant(text: str, count: Counter) -> Tree:
    pieces = count.pattern.findall(text)
    sizes, tokens = list(map(len, pieces)), [count[p] for p in pieces]
    cuts = range(0, len(pieces), LEAF)
    return Tree([sum(sizes[k : k + LEAF]) for k in cuts], [sum(tokens[k : k + LEAF]) for k in cuts])


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, stop, new in edits:
        if not at <= start <= stop <= len(text):
            raise ValueError(f"edit [{start}, {stop}) overlaps another one or leaves the text of {len(text)} characters")
        parts += [text[at:start], new]
        at = stop
    return "".join([*parts, text[at:]])


def apply(tree: Tree, text: str, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
    """Brings the tree up to date with the edits; returns the new text and how many characters were encoded again.

    Left of the edit in hand the tree is in the new text's positions, right of it ``shift`` behind.
    """
    new, shift, again, k = edited(text, edits), 0, 0, 0
    while k < len(edits):
        first, begin = tree.find(max(0, edits[k][0] + shift - 2))
        last, upto, grown = first, begin, 0

        def reach(position: int) -> None:
            """Extend the region over the leaf that holds the position."""
            nonlocal last, upto
            leaf, start = tree.find(position)
            if leaf >= last:
                last, upto = leaf, start + tree.chars[tree.width + leaf]

        def absorb() -> None:
            """Take in all edits that begin in the region."""
            nonlocal k, grown
            while k < len(edits) and (edits[k][0] + shift <= upto or last == tree.leaves - 1):
                start, stop, words = edits[k]
                grown += len(words) - (stop - start)
                reach(stop + shift)
                k += 1

        reach(edits[k][0] + shift)
        absorb()
        cuts: list[tuple[int, int]] = []
        at = begin
        for piece in count.pattern.finditer(new, begin):
            while at > upto + grown and last < tree.leaves - 1:  # no cut at the old end: go on to the next leaf
                reach(upto)
                absorb()
            if at == upto + grown and (last < tree.leaves - 1 or at == len(new)) and cuts:
                break
            at = piece.end()
            cuts.append((at - piece.start(), count[piece.group()]))
        while at > upto + grown and last < tree.leaves - 1:
            reach(upto)
            absorb()
        again += sum(size for size, _ in cuts)
        slots = last - first + 1
        step = max(1, -(-len(cuts) // slots))
        dealt = [cuts[i * step : (i + 1) * step] for i in range(slots)]
        tree.put(first, [(sum(c for c, _ in d), sum(t for _, t in d)) for d in dealt])
        shift += grown
    return new, again


def _build(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            trees = [plant(t.as_py() or "", count) for t in batch.column(1)]
            leaves = [t.columns() for t in trees]
            columns = [pa.array([t.total for t in trees], pa.int64()), *(pa.array([x[k] for x in leaves], pa.list_(pa.int64())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_tokens", "tree_chars", "tree_tokens"])

    return run


def build(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, n_tokens and the tree's leaves, of documents (doc_id, text). ``path``: a tiktoken rank file."""
    source = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    more = [T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("tree_chars", "tree_tokens"))]
    return source.mapInArrow(_build(path, pattern), T.StructType([*source.schema.fields, *more]))


def _apply(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            ids, texts, chars, tokens, edits = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "tree_chars", "tree_tokens", "edits"))
            out: list[tuple] = []
            for text, c, t, e in zip(texts, chars, tokens, edits, strict=True):
                tree, body = Tree(c.as_py(), t.as_py()), text.as_py() or ""
                todo = sorted(((x["start"], x["stop"], x["replacement"] or "") for x in e.as_py() or []), key=lambda x: x[:2])
                new, again = apply(tree, body, todo, count)
                out.append((new, tree.total, *tree.columns(), len(todo), again))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            names = ["doc_id", "text", "n_tokens", "tree_chars", "tree_tokens", "n_edits", "n_again"]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))], names)

    return run


def apply_edits(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """The trees after the edits in their column ``edits`` (start, stop, replacement; in characters of the old text).

    Adds n_edits, and n_again: characters encoded again.
    """
    fields = [trees.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("tree_chars", "tree_tokens")]
    return trees.mapInArrow(_apply(path, pattern), T.StructType([*fields, T.StructField("n_edits", T.LongType()), T.StructField("n_again", T.LongType())]))


def _redactions(expression: str, replacement: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(expression)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("replacement", pa.string())]))
        for batch in batches:
            edits = [
                [{"start": m.start(), "stop": m.end(), "replacement": replacement} for m in found.finditer(t.as_py() or "")]
                for t in batch.column(batch.schema.get_field_index("text"))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], [*batch.schema.names, "edits"])

    return run


def with_redactions(trees: DataFrame, expression: str = PERSONAL, replacement: str = "<redacted>") -> DataFrame:
    """A column ``edits`` that replaces what the expression finds in the text."""
    schema = T.StructType([*trees.schema.fields, T.StructField("edits", EDITS)])
    return trees.mapInArrow(_redactions(expression, replacement), schema)
