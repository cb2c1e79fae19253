from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tidemark.operators import phrases as p
from tidemark.operators import text as x

WORDS = ["ab", "cd", "e1", "f", "Gh", "K2", "zü", "x-y", "日本", "7"]
SCHEMA = "d long, company string, text string"


def plain(rows: list[tuple], n: int, threshold: int) -> dict:
    """(phrase_count, boilerplate_phrases) by document; a missing company counts as one, a missing document for companies only."""
    own: dict = {d: set() for d, _, _ in rows}
    users: dict = {}
    for d, company, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        for phrase in (tuple(words[k : k + n]) for k in range(len(words) - n + 1)):
            own[d].add(phrase)
            users.setdefault(phrase, set()).add(company)
    own[None] = set()
    return {d: (len(got), sum(len(users[phrase]) >= threshold for phrase in got)) for d, got in own.items()}


@pytest.mark.parametrize("several", [False, True])
def test_packed_phrases_count_as_plain_ones(frame, monkeypatch, several):
    """Repeated and missing ids, one id with several companies, and blocks of a few entries."""
    monkeypatch.setattr(p, "BLOCK_ENTRIES", 7)
    monkeypatch.setattr(p, "CUT_BYTES", 40)
    random.seed(5)
    text = lambda: " ".join(random.choice(WORDS) for _ in range(random.choice([0, 1, 3, 9, 20])))
    rows = [(d, random.choice(["a", "b", "c", None]), text()) for d in [*range(20), *range(8), 3, 3, 3, None, None]]
    rows += [(30, "a", None), (31, "b", "日本 — ü"), (32, "a", "ab cd"), (33, None, "E1 f"), (34, "c", "ab, cd; e1. F")]
    table = frame(rows, SCHEMA).repartition(3)
    phrases = x.distinct_phrases(table, ["d", "company"], "text", 2, several=several)
    out = x.originality(phrases, table, "d", x.boilerplate(phrases, "company", 3)).collect()
    assert {r.d: (r.phrase_count, r.boilerplate_phrases) for r in out} == plain(rows, 2, 3) | {None: (0, 0)}
    assert len({r.boilerplate_phrases for r in out}) > 3


def test_a_shingle_takes_twelve_bytes_of_disk(frame, tmp_path):
    """Rows of ids and whole keys took 16."""
    random.seed(6)
    rows = [(10**12 + d, f"src{d % 20}", " ".join(f"w{random.randrange(5000)}" for _ in range(507))) for d in range(400)]
    phrases = x.distinct_phrases(frame(rows, SCHEMA).repartition(2), ["d", "company"], "text")
    phrases.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) / (400 * 500) < 12.5


def test_keys_that_differ_in_their_last_bits_only():
    hi = np.array([9, 5, 5, 9, 5, 1], np.uint64)
    lo = np.array([1, 7, 2, 1, 7, 3], np.uint32)
    unit = np.array([0, 4, 1, 2, 3, 0])
    order = p.in_order()(hi, lo, unit)
    assert [(hi[k], lo[k], unit[k]) for k in order] == [(1, 3, 0), (5, 2, 1), (5, 7, 3), (5, 7, 4), (9, 1, 0), (9, 1, 2)]
    hi, lo, unit = hi[order], lo[order], unit[order]
    fresh = np.array([1, 1, 1, 0, 1, 0], bool)
    write, read, _, read_few = p.coder()
    data = write(hi, lo, fresh, unit, 4, np.array([0, 3]))
    got = read(data, 0)
    assert [k.tolist() for k in got] == [[1, 5, 5, 9], [3, 2, 7, 1], [0, 1, 2, 2, 3, 3], unit.tolist(), [0, 3]]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("d", T.ArrayType(T.LongType())), T.StructField("c", T.ArrayType(T.LongType())), T.StructField("h", T.BinaryType())])
    keys = [(1).to_bytes(8) + (2).to_bytes(4), (5).to_bytes(8) + (7).to_bytes(4), (5).to_bytes(8) + (6).to_bytes(4)]
    rows = {"k": [0], "b": [-3], "p": pa.array([data], pa.binary()), "c": [["a", "b"]], "d": pa.nulls(1, pa.list_(pa.int64()))}
    out = p.marked(schema)((pa.scalar(0),), pa.table(rows), pa.table({"k": [0], "s": [keys]}))
    assert out.column("k").to_pylist() == [-3] and read_few(out.column("h")[0].as_py()).tolist() == [3, 4]
