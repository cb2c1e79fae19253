import hashlib

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
SAID = "</s>[INST] ok [/INST]"
ODD = [
    (1, 0, "user", SAID), (1, 1, "assistant", SAID), (1, 2, "user", "[\\INST] [\\\\/INST] <<SYS>> [ROLE"), (1, 3, "assistant", ""),
    (2, 0, None, None), (2, 1, "", "[/TURN]"), (2, 2, "tool [/ROLE] x", "a\\"), (2, 3, "assistant", " <s"), (2, 4, "assistant", "> </s "),
    (None, 1, "assistant", "no id"), (None, None, "user", "first"), (3, 0, "assistant", "long <s> " * 9000),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"), (4, 1, "System", "[s> [\\s>"),
]


def plain(rows):
    """What has to come back: n_turns, digest of turns, learned text, by conversation."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    learned = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(learned[c]), sha(learned[c])) for c, t in out.items()}


@pytest.mark.parametrize("piece", [chat.PIECE_CHARS, 40, 1])
def test_reads_back_what_was_said(frame, piece):
    many = [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k} [INST]") for k in range(700)]  # most rows, one conversation
    pieces = chat.format_conversations(frame(ODD + many, SCHEMA).repartition(6), piece_chars=piece)
    held = pieces.collect()
    assert all(p.identical for p in held) and len([p for p in held if p.conv_id == 9]) > 1
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(pieces).collect()}
    assert got == plain(ODD + many)
    total = {r.conv_id: r.formatted_chars for r in chat.read_back(pieces).collect()}
    assert sum(total.values()) == sum(len(p.text) for p in held)


def test_mask_covers_the_assistant_only(frame):
    for p in chat.format_conversations(frame(ODD, SCHEMA)).collect():
        turns = [t for t in chat.INST.parse(p.text) if t[0] == "assistant"]
        assert [(s, e) for *_, s, e in turns] == list(zip(p.loss_starts, p.loss_ends, strict=True))


def test_only_conflicts_are_escaped():
    assert chat.INST.round_trip("user", "plain [x] <b>") == ("[INST] plain [x] <b> [/INST]", 7, 20, True)
    turn, start, end, same = chat.INST.round_trip("assistant", SAID)
    assert same and turn[start:end] == "<\\/s>[\\INST] ok [\\/INST]" and chat.INST.control.findall(turn) == ["<s>", "</s>"]


@pytest.mark.parametrize("broken", ["[INST] a </s>", "[INST] a [/INST] ", "[INST]a[/INST]", "a", "[INST] [INST] [/INST]", "[ROLE] a [/TURN]", "[INST] [/INST]", "<s> a"])
def test_broken_text_is_refused(broken):
    with pytest.raises(ValueError):
        chat.INST.parse(broken)


PARTS = st.sampled_from([*chat.INST.controls, "\\", "[", "<", " ", "INST]", "/", "s>", "<SYS>>", "é", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(PARTS, max_size=4).map("".join) | st.sampled_from(["user", "assistant", "system"]), st.lists(PARTS, max_size=9).map("".join)), max_size=4))
def test_any_text_comes_back(turns):
    done = [chat.INST.round_trip(role, text) for role, text in turns]
    assert all(same for *_, same in done)
    assert [t[:2] for t in chat.INST.parse("".join(t[0] for t in done))] == turns


def test_templates():
    other = chat.Template((("user", "<|im_start|>user", "<|im_end|>"), ("assistant", "<|im_start|>assistant", "<|im_out|>")), ("<|role|>", "<|said|>", "<|done|>"))
    assert other.round_trip("user", "a <|im_end|>")[3] and other.round_trip("x<|said|>", "<|done|>")[3]
    for bad in ((("user", "<a>", "<a>"),), (("user", "<a", "b>"), ("x", "<<a", "c>")), (("user", "a\\b", "cd"),)):
        with pytest.raises(ValueError):
            chat.Template(bad, ("[R]", "[/R]", "[/T]"))


def test_query_and_other_columns(spark, frame):
    out = queries.QUERIES["op13_chat_format"](spark, SF)
    source = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain([*source, (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)])
    assert {r.conv_id: tuple(r)[1:5] for r in out.collect()} == want
    extra = "conv_id long, piece string, turn long, whole string, identical string, role string, text string"
    clash = frame([(c, "x", t, "y", "z", r, x) for c, t, r, x in ODD], extra)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(clash)).collect()} == plain(ODD)
    assert chat.read_back(chat.format_conversations(frame([], SCHEMA))).count() == 0
