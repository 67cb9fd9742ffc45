"""Chat formatting by incremental black-box rendering (operator 9).

A template is any function ``messages -> str``.  The operator renders
successive prefixes of a conversation and compares consecutive outputs: the
part that turn k adds is the span of turn k.  A template that changes what it
said about earlier turns (it *rewrites history*) is detected, because the
earlier output is then no prefix of the later one.

Rows are sorted by (conversation, turn) and streamed, so a task holds one turn
and at most ``window`` turns of history, however long a conversation is.

Defined results: null text or role is empty; rows with equal (conversation,
turn) are ordered by role and text; a null conversation id is a conversation
of its own; a null turn sorts first; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

__all__ = ["escape", "unescape", "render", "turn_spans", "read_back", "formatted_turns", "digests", "HistoryRewritten"]

Message = dict[str, str]

# Control strings of the template and of common public chat formats.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("(?=%s)(.)" % "|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|turn:(.*?)\|>(.*?)<\|end\|>\n", re.S)
OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>\n"


class HistoryRewritten(ValueError):
    """A template's output for a longer prefix does not continue the shorter one's."""


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, then one is put after the first character of every control string."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(messages: list[Message]) -> str:
    """The default template: every turn is marked by its role and an end marker; texts and roles are escaped."""
    return "".join(f"{OPEN}{escape(m['role'])}{CLOSE}{escape(m['text'])}{END}" for m in messages)


def turn_spans(messages: Iterator[Message], template: Callable[[list[Message]], str] = render,
               window: int = 64) -> Iterator[str]:
    """What each turn adds to the output, found by rendering successive prefixes.

    History beyond ``window`` turns is cut to its last half before it is
    rendered again, so the work per turn is bounded; the turn at the cut is
    rendered with both histories, and a template for which they differ raises
    :class:`HistoryRewritten`, like one that changes earlier output.
    """
    history: list[Message] = []
    before = template([])
    for m in messages:
        after = template([*history, m])
        if not after.startswith(before):
            raise HistoryRewritten(f"the output after {len(history) + 1} turns does not continue the one before")
        added = after[len(before):]
        yield added
        history.append(m)
        before = after
        if len(history) >= window:
            short = history[-(window // 2):]
            less = template(short)
            if not less.startswith(template(short[:-1])) or less[len(template(short[:-1])):] != added:
                raise HistoryRewritten(f"a turn's output depends on turns more than {window // 2} back")
            history, before = short, less


def read_back(span: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted output; anything but whole turns raises ValueError."""
    found, at = [], 0
    for m in _TURN.finditer(span):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(span):
        raise ValueError("the output is not a sequence of marked turns")
    return found


def _conversations(batches, template, window):
    """Streams (conversation id, iterator of (message, span)) over sorted rows."""
    def rows():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

    source = rows()
    head = next(source, None)
    while head is not None:
        conv = head[0]
        seen: list = []

        def messages():
            nonlocal head
            while head is not None and head[0] == conv:
                m = {"role": head[2] or "", "text": head[3] or ""}
                seen[:] = [head[1], m]
                head = next(source, None)
                yield m

        def spans():
            for span in turn_spans(messages(), template, window):
                yield seen[0], seen[1], span
        each = spans()
        yield conv, each
        for _ in each:
            pass


def _sorted(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    c = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                             F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_turns(conversations: DataFrame, template: Callable[[list[Message]], str] = render,
                    learn_roles=("assistant",), window: int = 64, conv_id: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, start and end of its span in the formatted conversation (code points),
    formatted (the span) and in_loss (whether its text counts for the loss)."""
    c = _sorted(conversations, conv_id, turn, role, text)
    kinds = {f.name: f.dataType.simpleString() for f in c.schema.fields}
    made = pa.schema([("conv_id", to_arrow_type(c.schema["conv_id"].dataType)), ("turn", to_arrow_type(c.schema["turn"].dataType)),
                      ("start", pa.int64()), ("end", pa.int64()), ("formatted", pa.string()), ("in_loss", pa.bool_())])

    def run(batches):
        names = ["conv_id", "turn", "start", "end", "formatted", "in_loss"]
        out = [[] for _ in names]
        for conv, each in _conversations(batches, template, window):
            at = 0
            for number, m, span in each:
                for column, v in zip(out, (conv, number, at, at + len(span), span, m["role"] in learn_roles), strict=True):
                    column.append(v)
                at += len(span)
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, out, strict=True)), schema=made)
                    out = [[] for _ in names]
        yield pa.RecordBatch.from_pydict(dict(zip(names, out, strict=True)), schema=made)

    return c.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, start bigint, end bigint, formatted string, in_loss boolean")


def digests(conversations: DataFrame, template: Callable[[list[Message]], str] = render, learn_roles=("assistant",),
            window: int = 64, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, everything read back from the formatted output: n_turns, digest of the turns,
    length and digest of the text under the loss mask, length of the output."""
    c = _sorted(conversations, conv_id, turn, role, text)
    made = pa.schema([("conv_id", to_arrow_type(c.schema["conv_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        out = []
        for conv, each in _conversations(batches, template, window):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, span in each:
                size += len(span)
                for who, said in read_back(span):
                    n += 1
                    turns.update(f"{who}\n{said}\n".encode())
                    if who in learn_roles:
                        chars += len(said)
                        loss.update(said.encode())
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), made)], schema=made)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), made)], schema=made)

    return c.mapInArrow(run, f"conv_id {c.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, "
                             "loss_chars bigint, loss_sha256 string, formatted_chars bigint")
