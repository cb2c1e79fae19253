"""Token ids of whole texts by a public tokenizer, as packed bytes, with a bounded memory of words.

``word_bpe_49k.json`` drops white space and never merges across it or across the cut of its own
pattern (letters, single digits, other runs), so a text's ids are those of its pieces one after the
other. Texts of ASCII and Latin-1 letters are cut by that pattern here, and only pieces not in memory
go to the tokenizer, many at a time. All other texts are split at plain spaces and their words go to
the tokenizer whole, where composition and case rules of Unicode apply.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

#: Fixed: the tokenizer's cut of plain lower-case text.
CUT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
NOT_PLAIN = re.compile("[^ \t\n\r!-~À-ÖØ-öø-ÿ]")
SPACE = re.compile("[ \t\n\r]+")
#: Pieces in memory (twice as many for a while); characters worked on at a time.
MOST_PIECES, GROUP = 250_000, 1 << 20


class Packed:
    """Ids as little-endian unsigned 32-bit numbers, one after the other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a piece
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def hold(self, pieces: set[str], plain: bool) -> None:
        """Make sure that all pieces are in memory."""
        held, older = self.held, self.older
        missing = []
        for piece in pieces:
            if piece not in held:
                if (ids := older.get(piece)) is None:
                    missing.append(piece)
                else:
                    held[piece] = ids
        if plain and missing:
            ids = self.encode(" ".join(missing))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(missing):
                raw, at = ids.tobytes(), 0
                for piece, stop in zip(missing, (4 * stops).tolist(), strict=True):
                    held[piece] = raw[at:stop]
                    at = stop
                return
        for piece in missing:
            held[piece] = self.encode(piece).tobytes()

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        for group in _groups(texts):
            if len(self.held) > MOST_PIECES:
                self.held, self.older = {}, self.held
            cut, plain, other = [], set(), set()
            for text in group:
                if "<|" in text or NOT_PLAIN.search(text):
                    cut.append(SPACE.split(text))
                    other.update(cut[-1])
                else:
                    cut.append(CUT.findall(text.lower()))
                    plain.update(cut[-1])
            self.hold(plain, True)
            self.hold(other - plain, False)
            get = self.held.__getitem__
            for pieces in cut:
                yield b"".join(map(get, pieces))
        self.older = {}


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


@functools.cache
def packed(path: str) -> Packed:
    return Packed(path)
