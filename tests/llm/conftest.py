from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
#: Column names that the operators use themselves.
CLASH = ["row", "key", "check", "fp", "n", "h", "cuts", "lang_pred", "score", "kept"]


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest table, with the odd cases: null and empty texts, a null id, repeats, a long text."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"word{k % 977} {k}" for k in range(20_000))
    same = rows[3][1]
    return [*rows, (900, None), (901, ""), (902, " \n\t "), (903, same), (903, same), (None, same), (None, "no id here"), (904, long), (905, "Ünïcode ßtraße 日本語 ΑΣ  x")]


@pytest.fixture(scope="session")
def documents(frame, texts):
    return frame(texts, "doc_id long, text string")


@pytest.fixture(scope="session")
def crowded(frame, texts):
    """The same with columns whose names clash with those of the operators."""
    rows = [(k, *([str(k)] * len(CLASH)), text) for k, text in texts]
    return frame(rows, "doc_id long, " + ", ".join(f"{c} string" for c in CLASH) + ", text string")


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([], "doc_id long, text string")
