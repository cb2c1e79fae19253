from collections import Counter

import pytest
from conftest import SF

from tidemark.llm import licenses as li

APACHE = """   Copyright 2020 Foo Inc.

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def plain(documents, least=li.LEAST):
    """Every window of every text, bigram by bigram."""
    out = {}
    for doc_id, text in documents:
        words = li.normal_words(text or "")
        pairs = list(zip(words, words[1:]))
        for name, body in li.TEMPLATES.items():
            template = li.normal_words(body)
            wanted = list(zip(template, template[1:]))
            size = min(len(pairs), len(wanted))
            starts = {min(i, len(pairs) - size) for i, p in enumerate(pairs) if p in wanted}
            for s in starts:
                window = Counter(pairs[s : s + size])
                dice = 2.0 * sum(min(n, window[p]) for p, n in Counter(wanted).items()) / (size + len(wanted))
                if dice >= least:
                    best, windows = out.get((doc_id, name), ((0, 0), 0))
                    out[doc_id, name] = max(best, (dice, -s)), windows + 1
    return {k: (dice, -s, n) for k, ((dice, s), n) in out.items()}


@pytest.fixture(scope="module")
def notices():
    mit, prose = li.TEMPLATES["MIT-text"], "and then the people went home to the river " * 12
    marked = lambda text, mark: "\n".join(f"{mark} {line}" for line in text.splitlines())
    return [
        (1, "Some prose.\nReleased under the MIT license\nMore."), (2, f"{prose}\n{APACHE}\nint main() {{}}\n" * 2), (3, mit.replace("Permission is hereby granted", "Permission is granted").replace(" ", "\n", 5)),
        (4, "the license of the work is not stated and nothing is released"), (5, None), (6, ""), (7, "license"), (8, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!"),
        (8, "x LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!"), (9, "word " * 50_000 + "released under the mit license"), (10, "Copyright 2020 Foo. Released under the MIT License."),
        (11, f"{prose} all of it is released under the MIT License, as they said, {prose}"), (12, f"/*\n{marked(GPL, ' *')}\n */\nint x;"), (13, f"{marked(APACHE, '#')}\nimport os"), (None, marked(GPL, "//")),
        (14, "Licensed under CC BY-NC-SA 4.0."), (15, "the license, the license, the license " * 300), (16, APACHE[: len(APACHE) // 2]), (17, "Released under the MIT"), (18, li.TEMPLATES["ISC"] + " x " + li.TEMPLATES["ISC"]),
    ]


def test_notices_are_found(frame, nothing, notices):
    out = {(r.doc_id, r.license): r for r in li.scan(frame(notices, "doc_id long, text string")).collect()}
    assert {k for k, name in out if name == "MIT"} == {1, 9, 10, 11, 17} and out[9, "MIT"].first_word == 50_000
    assert {k for k, name in out if name == "Apache-2.0-header"} == {2, 13} and {k for k, name in out if name == "GPL-3.0-header"} == {12, None}
    assert (3, "MIT-text") in out and not {k for k, _ in out} & {4, 5, 6, 7, 15}
    assert li.scan(nothing).collect() == []


def test_equals_plain_version(spark, frame, notices):
    out = {(r.doc_id, r.license): (r.dice, r.first_word, r.windows) for r in li.scan(frame(notices, "doc_id long, text string")).collect()}
    assert out == plain(notices)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {(r.doc_id, r.license): (r.dice, r.first_word, r.windows) for r in li.scan(docs).collect()}
    assert out == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_columns_that_clash(frame, notices):
    rows = [(k, "x", 1, "y", t) for k, t in notices[:3]]
    out = li.scan(frame(rows, "doc_id long, words string, n int, pairs string, text string"))
    assert {(r.doc_id, r.license) for r in out.collect()} == set(plain(notices[:3]))


@pytest.mark.parametrize("name", list(li.TEMPLATES))
def test_needed_words_leave_too_few_bigrams(name):
    text = li.TEMPLATES[name]
    words, all_pairs = set(li.needed_words(text, 0.8)), li.numbered_bigrams(text)
    without = [p for p in all_pairs if not words & set(p.split()[:2])]
    assert len(without) < len(all_pairs) * 0.8 / 1.2


def test_no_python_in_the_plan(documents, capsys):
    li.scan(documents).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))


def test_no_filter_works_a_step_out_again(frame, capsys):
    rows = frame([(1, "Released under the MIT License."), (2, "under the MIT tent")], "doc_id long, text string")
    found = li.scan(rows)
    assert [r.license for r in found.collect()] == ["MIT"]
    found.explain(True)
    optimized = capsys.readouterr().out.partition("== Optimized Logical Plan ==")[2].partition("== Physical Plan ==")[0]
    assert not [line for line in optimized.splitlines() if "Filter" in line and "lambdafunction" in line]
