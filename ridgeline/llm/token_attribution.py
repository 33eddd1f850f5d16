"""Token counts by section: encode once, then join token spans to section spans.

The whole document is encoded once. The ids' byte lengths give each token's byte span, and so its character span (a token
that holds part of a character counts as covering it). Sections are spans that tile the document; a token inside one section
is that section's, and a token that crosses a boundary is allocated by a rule:

- ``start``: to the section of its first character (the default);
- ``end``: to the section of its last character;
- ``majority``: to the section that holds most of its bytes, the earliest on a tie.

Each token is counted exactly once under every rule, so a document's counts add up to its tokens.

Defined results: null and empty texts give one empty section with 0 tokens; sections may be empty; repeated rows give
repeated results; an empty table an empty one. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.common import encode, slices, token_byte_lengths

RULES = ("start", "end", "majority")


def lines(text: str) -> list[tuple[str, int, int]]:
    """Sections (name, start, end): the text's lines with their line breaks; they tile the text."""
    out, at = [], 0
    while True:
        end = text.find("\n", at)
        if end < 0:
            return [*out, ("line", at, len(text))] if at < len(text) or not out else out
        out.append(("line", at, end + 1))
        at = end + 1


def fields(parts: dict[str, str]) -> tuple[str, list[tuple[str, int, int]]]:
    """Several fields as one text with a line break after each, and their sections."""
    text, sections = "", []
    for name, value in parts.items():
        sections.append((name, len(text), len(text) + len(value) + 1))
        text += value + "\n"
    return text, sections


def char_to_byte(text: str, raw: bytes) -> np.ndarray | None:
    """Byte offset of each character and of the end; None if they are the same."""
    if len(text) == len(raw):
        return None
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    return np.append(np.flatnonzero(lead), len(raw))


def allocate(token_bytes: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; bounds: byte offsets of the sections' starts and the end."""
    n = len(bounds) - 1
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    # the last section whose start is not after the place: empty sections never get a token
    first = np.searchsorted(bounds[1:], starts, side="right")
    last = np.searchsorted(bounds[1:], ends - 1, side="right")
    crossing = first != last
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    elif rule == "majority":
        owner = first.copy()
        for k in np.flatnonzero(crossing).tolist():
            within = [min(ends[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(within))
    else:
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections: Callable[[str], list[tuple[str, int, int]]] = lines) -> DataFrame:
    """Per section ``(id, section, name, start, end, n_tokens, n_crossing, doc_tokens)``; offsets in code points."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    names = [id_col, "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = token_byte_lengths(ranks)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                take, cols = [], [[] for _ in names[1:]]
                for k, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    raw = text.encode("utf-8", "surrogatepass")
                    own = sections(text)
                    bounds = np.array([s[1] for s in own] + [own[-1][2]], dtype=np.int64)
                    if (at := char_to_byte(text, raw)) is not None:
                        bounds = at[bounds]
                    width = widths[np.array(encode(ranks, text), dtype=np.int64)]
                    tokens, crossing = allocate(width, bounds, rule)
                    take += [k] * len(own)
                    for col, values in zip(cols, (range(len(own)), [s[0] for s in own], [s[1] for s in own], [s[2] for s in own], tokens.tolist(), crossing.tolist(), [len(width)] * len(own)), strict=True):
                        col.extend(values)
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, section long, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
