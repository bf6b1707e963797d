"""Chat formatting with compiled templates and generation marks.

Rows (conversation, turn, role, text) are dealt by conversation and sorted by turn; a task then walks through
its sorted rows once. Templates render from the stream, so no conversation is ever held whole, however long: the
output comes in parts of about ``PART_CHARS`` characters, in order, with the spans that lie inside
``{% generation %}`` marks (code points from the conversation's start).

Defined cases: null text and null role are empty; a null conversation id is a conversation of its own; null
turns come first; rows with the same turn are kept and ordered by role, then text; an empty table gives no
rows; extra columns are ignored. A role may hold any characters, line breaks too: the mark behind it is a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.llm.templates import Escaper, compile_template

PART_CHARS = 1 << 16
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN:", "]\n", "[/TURN]"]
TEMPLATE = """
{%- for m in messages -%}
{%- if loop.first %}{{ '<s>' }}{% endif -%}
{%- if m.role == 'user' %}{{ '[INST] ' }}{{ m.text | escape }}{{ ' [/INST]' }}
{%- elif m.role == 'assistant' %}{{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- else %}{{ '[TURN:' }}{{ m.role | escape }}{{ ']\\n' }}{{ m.text | escape }}{{ '[/TURN]' }}
{%- endif -%}
{%- endfor -%}
"""
PARTS = "conv_id long, part int, chars_before long, formatted string, loss array<struct<start: long, end: long>>"
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chars_before", pa.int64()), ("formatted", pa.string()),
                    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def dealt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return (conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                 F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _rows(batches, *names) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: list[str] = CONTROLS,
                         **columns) -> DataFrame:
    """The formatted text of each conversation in ordered parts, with the spans under the loss mask."""
    def run(batches):
        render = compile_template(template, Escaper(controls).escape)
        out: list[tuple] = []
        size = 0
        for conv, rows in groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            part, at, buf, loss = 0, 0, [], []
            begun = 0
            for s, gen in render(messages=({"role": r, "text": t} for _, r, t in rows)):
                if gen and s:
                    loss.append({"start": at, "end": at + len(s)})
                buf.append(s)
                at += len(s)
                if at - begun >= PART_CHARS:
                    out.append((conv, part, begun, "".join(buf), loss))
                    size += at - begun
                    part, begun, buf, loss = part + 1, at, [], []
                    if size >= 1 << 20:
                        yield _batch(out, _PARTS)
                        out, size = [], 0
            if buf or part == 0:
                out.append((conv, part, begun, "".join(buf), loss))
                size += at - begun
                if size >= 1 << 20:
                    yield _batch(out, _PARTS)
                    out, size = [], 0
        yield _batch(out, _PARTS)

    return dealt(conversations, **columns).mapInArrow(run, PARTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


TURN = re.compile(r"\[INST\] (.*?) \[/INST\]| (.*?)</s>|\[TURN:(.*?)\]\n(.*?)\[/TURN\]", re.S)


class Reader:
    """Reads turns back from formatted text that arrives in parts."""

    def __init__(self):
        self.unescape = Escaper(CONTROLS).unescape
        self.buffer, self.begun = "", False

    def turns(self, part: str) -> Iterator[tuple[str, str]]:
        s = self.buffer + part
        at = 0
        if not self.begun and len(s) >= 3:
            if not s.startswith("<s>"):
                raise ValueError("no begin mark")
            at, self.begun = 3, True
        while m := TURN.match(s, at):
            at = m.end()
            role = "user" if m[1] is not None else "assistant" if m[2] is not None else self.unescape(m[3])
            yield role, self.unescape(next(x for x in (m[1], m[2], m[4]) if x is not None))
        self.buffer = s[at:]


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SUMMARY = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts say (default template): turns, text under the loss mask, lengths.

    ``parts`` is ``format_conversations``' result, read in its own order (no shuffle in between).
    """
    def run(batches):
        out = []
        unescape = Escaper(CONTROLS).unescape
        for conv, rows in groupby(_rows(batches, "conv_id", "chars_before", "formatted", "loss"), key=lambda r: r[0]):
            reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, before, s, spans in rows:
                for role, text in reader.turns(s):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for x in spans:
                    t = unescape(s[x["start"] - before:x["end"] - before])
                    loss.update(t.encode())
                    loss_chars += len(t)
                chars += len(s)
            if reader.buffer:
                raise ValueError(f"conversation {conv}: text left over")
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield _batch(out, _SUMMARY)
                out = []
        yield _batch(out, _SUMMARY)

    return parts.mapInArrow(run, SUMMARY)
