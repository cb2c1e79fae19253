"""Conversations as training text, checked by reading the text back.

A template marks every turn by control strings. Each turn is rendered, the rendered text is parsed by a
deterministic parser, and the recovered role and text are compared with the source. As long as they
differ, one more kind of control string that stands in the text is escaped (a backslash after its first
character; one that has backslashes there already gets one more), until they are identical. Nothing is
escaped that parses as it is.

Rows are dealt by ranges of (conv_id, turn), so a conversation that holds a large share of all rows is
rendered by many tasks. Turns follow each other in pieces of about ``PIECE_CHARS``, cut between turns; a
task holds one piece at a time. Pieces carry the spans of the assistant's texts, the loss mask.
``read_back`` parses the pieces again. Conversations that lie inside one task are digested there; only
those at the edges of a range are brought together, piece by piece, as a digest has to run in order.

Defined results: a null text is empty; a null role is a role without a name; rows without conv_id are one
conversation, and rows without turn come first; rows of one turn are ordered by role and then by a hash
of the text, and repeated rows are repeated turns; a text of any length is one turn; an empty table gives
an empty one. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.columns import pieces

#: Characters of a piece (it ends with the turn that reaches them), and bytes of text that a task reads or holds at a time.
PIECE_CHARS, READ_BYTES = 1 << 14, 1 << 22


@dataclass(frozen=True)
class Template:
    """Control strings: the pair around the text of a known role, and the three of any other role."""

    roles: tuple[tuple[str, str, str], ...] = (
        ("user", "[INST]", "[/INST]"),
        ("assistant", "<s>", "</s>"),
        ("system", "<<SYS>>", "<</SYS>>"),
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: str = "assistant"

    def __post_init__(self) -> None:
        controls = self.controls
        if len(set(controls)) < len(controls) or any(len(c) < 2 or "\\" in c or c != c.strip() for c in controls):
            raise ValueError("control strings are distinct, of two characters or more, without backslashes and outer white space")
        if any(self.mark.search(c, 1) for c in controls):
            raise ValueError("a control string holds another")

    @functools.cached_property
    def controls(self) -> list[str]:
        return [c for _, *pair in self.roles for c in pair] + list(self.other)

    @functools.cached_property
    def mark(self) -> re.Pattern:
        """A control string, escaped any number of times. Group 1 holds its first character, 2 the backslashes, 3 what follows."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(sorted({re.escape(c[1:]) for c in self.controls}, key=len, reverse=True))
        return re.compile(rf"([{firsts}])(\\*)(?=({rests}))")

    @functools.cached_property
    def control(self) -> re.Pattern:
        return re.compile("|".join(sorted(map(re.escape, self.controls), key=len, reverse=True)))

    def kinds(self, text: str) -> list[str]:
        """The control strings, escaped or not, in the order of their first place in the text."""
        return list(dict.fromkeys(m[1] + m[3] for m in self.mark.finditer(text)))

    def escape(self, text: str, kinds: set[str]) -> str:
        return self.mark.sub(lambda m: f"{m[1]}\\{m[2]}" if m[1] + m[3] in kinds else m[0], text)

    def unescape(self, text: str) -> str:
        return self.mark.sub(lambda m: m[1] + m[2][1:], text)

    def render(self, role: str, text: str) -> tuple[str, int]:
        """The turn, and the place where its text begins. Role and text are escaped already."""
        for name, opening, closing in self.roles:
            if role == name:
                return f"{opening} {text} {closing}", len(opening) + 1
        opening, middle, closing = self.other
        head = f"{opening} {role} {middle} "
        return f"{head}{text} {closing}", len(head)

    def parse(self, text: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of all turns; start and end are the place of the escaped text.

        Left to right without a choice: an opening decides which control string has to come next.
        Raises ValueError where another one comes, or anything stands between turns.
        """
        closings = {opening: (name, closing) for name, opening, closing in self.roles}
        turns, at = [], 0

        def until(expected: str) -> tuple[int, int]:
            """The span up to the next control string, which has to be the expected one."""
            nonlocal at
            found = self.control.search(text, at)
            if not found or found[0] != expected or found.start() < at + 2 or text[at] != " " or text[found.start() - 1] != " ":
                raise ValueError(f"{expected} expected after {at}")
            start, end = at + 1, found.start() - 1
            at = found.end()
            return start, end

        while at < len(text):
            found = self.control.match(text, at)
            opening = found[0] if found else None
            at += len(opening or "")
            if opening in closings:
                role, closing = closings[opening]
            elif opening == self.other[0]:
                start, end = until(self.other[1])
                role, closing = self.unescape(text[start:end]), self.other[2]
            else:
                raise ValueError(f"a turn has to begin at {at}")
            start, end = until(closing)
            turns.append((role, self.unescape(text[start:end]), start, end))
        return turns

    def round_trip(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """The rendered turn, the span of its text, and whether parsing gives the source back."""
        kinds: set[str] = set()
        waiting = [k for k in self.kinds(text) + self.kinds(role)]
        while True:
            escaped = self.escape(text, kinds)
            turn, start = self.render(self.escape(role, kinds), escaped)
            try:
                same = [t[:2] for t in self.parse(turn)] == [(role, text)]
            except ValueError:
                same = False
            if same or not waiting:
                return turn, start, start + len(escaped), same
            kinds.add(waiting.pop(0))


INST = Template()


def _assemble(template: Template, piece_chars: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33  # ranges are in order, so are the pieces
        ready: list[tuple] = []
        held = made = size = 0
        conv, parts, starts, ends, same = None, [], [], [], True
        begun = alone = False  # alone: nothing of the conversation stands in an earlier piece or task

        def finish(whole: bool) -> None:
            nonlocal held, made, size, parts, starts, ends, same
            ready.append((conv, base + made, len(parts), "".join(parts), starts, ends, same, whole))
            held, made = held + size, made + 1
            size, parts, starts, ends, same = 0, [], [], [], True

        def emit() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(values, field.type) for values, field in zip(zip(*ready, strict=True), schema, strict=True)]
            ready.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in pieces(batches, READ_BYTES):  # sorted by conversation and turn
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and key != conv:
                    if parts:
                        finish(alone)
                    alone = True
                elif size >= piece_chars:
                    finish(False)
                    alone = False
                turn, start, end, ok = template.round_trip(role or "", text or "")
                if (role or "") == template.learned:
                    starts.append(size + start)
                    ends.append(size + end)
                conv, begun, same = key, True, same and ok
                parts.append(turn)
                size += len(turn)
                if held >= READ_BYTES or len(ready) >= 4096:
                    yield emit()
        if parts:
            finish(False)  # it may go on in the next range
        if ready:
            yield emit()

    return run


def format_conversations(rows: DataFrame, template: Template = INST, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as pieces of text, in the order of ``piece`` within a conversation.

    conv_id, piece, n_turns, text, loss_starts and loss_ends (code points in the piece),
    identical (the round trip of every turn succeeded), whole (the piece is the whole conversation;
    false also where a range of rows ends with it).
    """
    source = rows.select("conv_id", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    keys = [F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")), F.xxhash64("text")]
    dealt = source.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    fields = T.StructType.fromDDL("piece long, n_turns long, text string, loss_starts array<long>, loss_ends array<long>, identical boolean, whole boolean")
    schema = T.StructType([rows.schema["conv_id"], *fields])
    return dealt.mapInArrow(_assemble(template, piece_chars, to_arrow_schema(schema)), schema)


@dataclass
class Digest:
    """What is read back from the pieces of one conversation, in order."""

    template: Template

    def __post_init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        self.chars += len(text)
        for role, said, *_ in self.template.parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for start, end in zip(starts, ends, strict=True):
            learned = self.template.unescape(text[start:end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digest_whole(template: Template, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, READ_BYTES):  # conv_id, piece, text, loss_starts, loss_ends, whole
            rows = []
            for conv, piece, text, starts, ends, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole:
                    digest = Digest(template)
                    digest.add(text, starts, ends)
                    rows.append((conv, piece, *digest.row(), None, None, None))
                else:
                    rows.append((conv, piece, *[None] * len(READ), text, starts, ends))
            columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _digest_cut(template: Template, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in pieces(batches, READ_BYTES):  # sorted by conversation and piece
            for key, _, *read, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest and key != conv:
                    rows.append((conv, *digest.row()))
                    digest = None
                if text is None:
                    rows.append((key, *read))
                else:
                    conv, digest = key, digest or Digest(template)
                    digest.add(text, starts, ends)
            if rows:
                yield emit()
        if digest:
            rows.append((conv, *digest.row()))
            yield emit()

    return run


def read_back(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """Per conversation what its pieces say: n_turns, digests of turns and of learned text, their lengths."""
    key = formatted.schema["conv_id"]
    read = T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields
    rest = T.StructType.fromDDL("text string, loss_starts array<long>, loss_ends array<long>").fields
    between, last = T.StructType([key, T.StructField("piece", T.LongType()), *read, *rest]), T.StructType([key, *read])
    source = formatted.select("conv_id", "piece", "text", "loss_starts", "loss_ends", "whole")
    digested = source.mapInArrow(_digest_whole(template, to_arrow_schema(between)), between)
    held = digested.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return held.mapInArrow(_digest_cut(template, to_arrow_schema(last)), last)


def oracle(template: Template = INST) -> str:
    """The digests in SQL, from the source rows."""
    ordered = "string_agg({0}, '' ORDER BY turn, role, text)"
    rests = "|".join(re.escape(c[1:]) for c in template.controls)
    firsts = "".join(sorted({re.escape(c[0]) for c in template.controls}))
    marks = f"len(regexp_extract_all({{0}}, '[{firsts}]\\\\*(?:{rests})'))"
    fixed = " ".join(f"WHEN '{name}' THEN {len(a) + len(b) + 2}" for name, a, b in template.roles)
    other = f"{sum(map(len, template.other)) + 4} + length(role) + {marks.format('role')}"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, CASE role {fixed} ELSE {other} END + length(text) + {marks.format('text')} AS chars, CASE WHEN role = '{template.learned}' THEN text ELSE '' END AS learned FROM c)
SELECT conv_id, count(*) AS n_turns, sha256({ordered.format("role || chr(10) || text || chr(10)")}) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256({ordered.format("learned")}) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""
