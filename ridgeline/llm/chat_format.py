"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of ``(role, text)`` to a string. Successive prefixes of a conversation are rendered
and each output is compared with the one before: what was added is the new turn's span. If the older output isn't a prefix of
the newer one, the template rewrites history; the conversation is marked, and the span starts where the outputs part. Where
a turn's text lies in its span is found by rendering the turn with two other texts: what both outputs share at the front
and at the back is the template's own. Control strings in texts are escaped before rendering, reversibly, so no text can
open or close a turn.

Turns are sorted and streamed, and come out as rows. Every prefix is rendered whole, however long, so a conversation takes
memory by its length and time by the square of its turns. A template may state how many turns it looks back, as an attribute
``looks_back``: what a turn adds then depends on no earlier ones, whose number included, and nothing before them is
rewritten. Only those turns are then held and rendered, in bounded memory and linear time, but the statement is believed:
rewriting is not looked for before them. ``chatml`` states nothing, so its prefixes are compared.

A span lies where the output stood when its turn was added. Where a later turn rewrites from before a span's end, that span
no longer holds; ``final_spans`` says which do.

Defined results: null texts and null roles are empty; rows are ordered by turn, then role, then text, nulls first; repeated
rows are turns of their own; conversations with a null id are one conversation. An empty table gives no rows. Only the named
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import slices

Template = Callable[[list[tuple[str, str]]], str]

#: Control strings that no text may bring in; fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes doubled, and one put into each control string after its first character."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def chatml(messages: list[tuple[str, str]]) -> str:
    """The default template; it gets texts and roles that are escaped."""
    return "".join([f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in messages])


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text, unescaped, of a turn that ``chatml`` wrote."""
    head, _, body = segment.removeprefix("<|im_start|>").removesuffix("<|im_end|>\n").partition("\n")
    while (len(head) - len(head.rstrip("\\"))) % 2:  # the line break was escaped
        more, _, body = body.partition("\n")
        head += "\n" + more
    return unescape(head), unescape(body)


class Renderer:
    """Renders one conversation turn by turn. ``looks_back``: turns that the template depends on, None for all."""

    def __init__(self, template: Template, looks_back: int | None = None):
        self.template, self.looks_back = template, looks_back
        self.held: list[tuple[str, str]] = []
        self.before, self.position, self.rewrites = "", 0, False

    def add(self, role: str, text: str) -> tuple[str, int, int, int, bool]:
        """The turn's span as a string, its start in the whole, the text's start and end in the span, and whether the text is there as it was given."""
        if self.looks_back is not None and len(self.held) > self.looks_back:
            self.held = self.held[len(self.held) - self.looks_back :]
            self.before = self.template(self.held)
        shared = len(self.before)
        self.held.append((role, text))
        now = self.template(self.held)
        if not now.startswith(self.before):
            self.rewrites = True
            shared = len(os.path.commonprefix([self.before, now]))
        span = now[shared:]
        one, two = (self.template([*self.held[:-1], (role, mark)])[shared:] for mark in ("\ue000", "\ue001"))
        head = len(os.path.commonprefix([one, two]))
        foot = len(os.path.commonprefix([one[:head:-1], two[:head:-1]]))
        start, end = head, len(span) - foot
        start_at = self.position - (len(self.before) - shared)
        self.position = start_at + len(span)
        self.before = now
        return span, start_at, start, end, span[start:end] == text


TURN_COLUMNS = "position long, role string, segment string, start long, end long, text_start long, text_end long, in_loss boolean, rewrites boolean, altered boolean"


def format_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn, in order within a partition: ``(conv, *TURN_COLUMNS)``.

    ``segment`` is what the turn adds to the conversation's output at ``start``; the text's offsets are in the output too,
    and ``in_loss`` says whether the loss mask covers it.
    """
    kind, looks_back = conversations.schema[conv_col].dataType.simpleString(), getattr(template, "looks_back", None)
    names = [conv_col, *(c.split()[0] for c in TURN_COLUMNS.split(", "))]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, *[pa.bool_()] * 3]
    rows = conversations.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    dealt = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, current, position = None, None, 0
        for batch in batches:
            for part in slices(batch):
                cols: list[list] = [[] for _ in kinds]
                for conv, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if renderer is None or conv != current:
                        renderer, current, position = Renderer(template, looks_back), conv, 0
                    span, at, a, b, same = renderer.add(escape_role(role or ""), escape(text or ""))
                    for col, value in zip(cols, (position, role or "", span, at, at + len(span), at + a, at + b, (role or "") in loss_roles, renderer.rewrites, not same), strict=True):
                        col.append(value)
                    position += 1
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return dealt.mapInArrow(run, f"`{conv_col}` {kind}, {TURN_COLUMNS}")


def final_spans(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Adds ``holds``: whether no later turn of the conversation rewrote the output from before the span's end."""
    later = Window.partitionBy(conv_col).orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("holds", F.coalesce(F.min("start").over(later) >= F.col("end"), F.lit(True)))


def digest(turns: DataFrame, conv_col: str = "conv_id", read: Callable[[str], tuple[str, str]] = parse_turn) -> DataFrame:
    """Per conversation, read back from its segments: counts and digests, and whether the template rewrote or altered anything.

    It streams format_turns' rows as they lie, so it must follow without a shuffle between; rows that don't follow each other
    by position are an error.
    """
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites", "altered"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                n, every, loss_chars, loss, chars, rewrites, altered = state
                done.append((current, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites, altered))

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 8
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *kinds], strict=True)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, position, segment, start, a, b, in_loss, rewrites, altered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position != (0 if state is None or conv != current else state[0]):
                    raise ValueError(f"turn {position} of conversation {conv} is out of order: the turns were dealt anew")
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False, False]
                role, text = read(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if in_loss:
                    under = unescape(segment[a - start : b - start])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] = start + len(segment)  # the output's length so far
                state[5] |= rewrites
                state[6] |= altered
            yield out(id_type)
        close()
        if id_type is not None:
            yield out(id_type)

    columns = f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, altered boolean"
    return turns.select(conv_col, "position", "segment", "start", "text_start", "text_end", "in_loss", "rewrites", "altered").mapInArrow(run, columns)
