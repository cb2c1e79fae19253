"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(documents, benchmark, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in benchmark:
        w = cut(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item) if item is not None else "null")
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in documents:
        w = cut(text)
        hit, items = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(codes, radius=2):
    """Root index of each code."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = np.array(codes, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def simhash(documents):
    codes = [fingerprint(t) for _, t in documents]
    root = components(codes)
    least = {}
    for (doc_id, _), r in zip(documents, root, strict=True):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return [(d, f"{c:016x}", least.get(r)) for (d, _), c, r in zip(documents, codes, root, strict=True)]


def pieces(documents, path, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = []
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def repeated(documents, size=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [(t or "").encode() for _, t in documents]
    seen = Counter(r[k : k + size] for r in raw for k in range(len(r) - size + 1))
    out = []
    for (doc_id, _), r in zip(documents, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = True
        flips = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g)
        out.append((doc_id, len(r), int(gone.sum()), int((flips == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
