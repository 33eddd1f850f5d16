"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the normalised words of all test items. A document's words are streamed through it while the longest
matching length is tracked; a length of ``window`` or more means that the last ``window`` words occur in some item. Items
shorter than a window count whole. Runs of words whose neighbouring pairs never occur in an item can't match two words, so
they are passed over by one vectorised look-up; what remains goes through the automaton word by word.

The items' texts go to the tasks, and each worker process builds the automaton once. It is bounded: items are taken in
blocks of at most ``BLOCK_WORDS`` words, one pass over the documents for each block; a pass is kept in the checkpoint folder before
the next block is read, so the driver holds one block's texts. The passes' spans are merged; one block is the common case.

Defined results: null or empty texts have no words and no hits; an item without words never occurs; items with equal texts
all count; an empty item table gives zero hits. Rows are independent: repeated rows give repeated results. Only the named
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ridgeline.llm.common import cut_lineage, fresh, slices

WINDOW = 8
#: Words of one automaton; about 750 bytes each in a worker, some 6 on the driver.
BLOCK_WORDS = 200_000

#: Bytes: A-Z become a-z; what is no letter, digit or part of a character over 127 becomes a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over item words, with the items that hold each window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [i for i, _ in items]
        spelled = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)] for _, text in items]
        for sequence in spelled:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.found: list[set[int]] = [set() for _ in self.link]  # items that hold the state's window
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)  # (words, item) of whole short items
        own: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(spelled):
            state, size = 0, 0
            for word in sequence:
                state, size = self.step(state, size, word)
                if size >= window:
                    self.found[self.at(state, window)].add(k)
            if 0 < len(sequence) < window:
                own.setdefault(self.at(state, len(sequence)), []).append((len(sequence), k))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = (*self.short[self.link[state]], *own.get(state, ()))
        self.up = [self.at(state, window) if self.length[state] >= window else 0 for state in range(len(self.link))]
        self.least = min((min(len(s), window) for s in spelled if s), default=0)
        pairs = {a * len(self.vocabulary) + b for s in spelled for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, word: int) -> int:
        """Add a word after the state ``last``, as in Blumer's construction, sharing what other items have already."""
        nxt, link, length = self.next, self.link, self.length
        if (known := nxt[last].get(word)) is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, word, known)
        new = self._state(length[last] + 1, {})
        while last >= 0 and word not in nxt[last]:
            nxt[last][word] = new
            last = link[last]
        if last < 0:
            link[new] = 0
        else:
            known = nxt[last][word]
            link[new] = known if length[known] == length[last] + 1 else self._clone(last, word, known)
        return new

    def _state(self, length: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, last: int, word: int, known: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[known]))
        self.link[copy], self.link[known] = self.link[known], copy
        while last >= 0 and self.next[last].get(word) == known:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def step(self, state: int, size: int, word: int) -> tuple[int, int]:
        """The state and the longest matching length after one more word."""
        nxt = self.next
        while state and word not in nxt[state]:
            state = self.link[state]
            size = self.length[state]
        if (to := nxt[state].get(word)) is not None:
            return to, size + 1
        return 0, 0

    def at(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a longer match that ended in ``state``."""
        while self.length[self.link[state]] >= size and state:
            state = self.link[state]
        return state

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a window: every neighbouring pair in them occurs in an item."""
        if not self.least or not len(ids):
            return
        if self.least == 1:
            joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        else:
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            code = ids[:-1].astype(np.int64) * len(self.vocabulary) + ids[1:]
            place = np.searchsorted(self.pairs, code[both])
            joined = np.zeros(len(both), dtype=bool)
            if len(self.pairs):
                joined[both] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == code[both]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + 1
        if self.least == 1:
            single = ids >= 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
            starts, ends = edges[::2], edges[1::2]
        wide = ends - starts >= self.least
        yield from zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)

    def scan(self, spelled: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with occurring windows."""
        hit = np.zeros(len(spelled) + 1, dtype=np.int32)
        items: set[int] = set()
        ids = np.fromiter(map(self.vocabulary.get, spelled, [-1] * len(spelled)), dtype=np.int64, count=len(spelled))
        for start, end in self.candidates(ids):
            state, size = 0, 0
            for k in range(start, end):
                state, size = self.step(state, size, int(ids[k]))
                if size >= self.window:
                    hit[k + 1 - self.window] += 1
                    hit[k + 1] -= 1
                    items |= self.found[self.up[state]]
                for length, item in self.short[state]:
                    if length <= size:
                        hit[k + 1 - length] += 1
                        hit[k + 1] -= 1
                        items.add(item)
        return np.cumsum(hit)[:-1] > 0, items


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the runs of hit words."""
    out: list[tuple[int, int]] = []
    joined = False
    for m, h in zip(WORD.finditer(text), hit.tolist(), strict=True):
        if h:
            out.append((out.pop()[0], m.end()) if joined else m.span())
        joined = h
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most ``most`` words, so that one automaton is bounded however many items there are.

    An item that alone has more than ``most`` words makes a block of its own.
    """
    block: list[tuple[object, str | None]] = []
    room = most
    for row in items.select(id_col, text_col).toLocalIterator():
        size = (row[1] or "").count(" ") + (row[1] or "").count("\n") + 1
        if block and size > room:
            yield block
            block, room = [], most
        block.append((row[0], row[1]))
        room -= size
    if block:
        yield block


_built: dict[tuple, Automaton] = {}


def built(block: list[tuple[object, str | None]], window: int) -> Automaton:
    """The block's automaton; a process keeps the last one."""
    key = (window, *block)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(block, window)
    return _built[key]


def _match_block(docs: DataFrame, block: list, row_cols: list[str], text_col: str, window: int) -> DataFrame:
    names = ["n_words", "hit_words", "item_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built(block, window)
        for batch in batches:
            for part in slices(batch):
                n, hits, found = [], [], []
                for text in part.column(len(row_cols)).to_pylist():
                    spelled = words(text)
                    hit, items = automaton.scan(spelled)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    n.append(len(spelled))
                    hits.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                    found.append(sorted({str(automaton.items[i]) for i in items}))
                out = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(row_cols)], *out], names=[*row_cols, *names])

    keys = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in row_cols)
    return docs.select(*row_cols, text_col).mapInArrow(run, f"{keys}, n_words long, hit_words array<struct<start:long,end:long>>, item_ids array<string>")


def match_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: ``(id, n_words, hit_words, item_ids)``; hit_words are merged ranges of word numbers."""
    blocks = item_blocks(items, item_id_col, item_text_col, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _match_block(docs, first, [id_col], text_col, window)
    # More than one block: rows get a number of their own, so that repeated ids stay apart, and the passes' spans are merged.
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    every = cut_lineage(_match_block(numbered, first, ["_row", "_id"], "_text", window))
    for block in itertools.chain((second,), blocks):
        every = every.unionByName(cut_lineage(_match_block(numbered, block, ["_row", "_id"], "_text", window).where(F.size("hit_words") > 0)))
    merged = every.groupBy("_row").agg(
        F.first("_id").alias(id_col), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hit_words"))).alias("ranges"), F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids")
    )
    return merged.select(id_col, "n_words", _union("ranges").alias("hit_words"), F.array_distinct("item_ids").alias("item_ids"))


def _union(ranges: str) -> F.Column:
    """Sorted ranges, merged where they meet."""
    return F.aggregate(
        ranges,
        F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )


def digest(matched: DataFrame, id_col: str = "doc_id", least_items: int = 2) -> DataFrame:
    """Counts and a digest of match_items' rows."""
    n_items = F.size("item_ids").cast("long")
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return matched.select(
        id_col, "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated")
    )


#: A document of which more than this share of words is hit goes as a whole.
COVERAGE = 0.5


def cut_hits(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; a removed span leaves a line break."""
    kept, at = [], 0
    for start, end in spans_of(text, hit):
        kept.append(text[at:start].rstrip(" "))
        at = end
    kept.append(text[at:].lstrip(" .,;:!?"))
    return "\n".join(x for x in kept if x)


def clean_text(text: str | None, automaton: Automaton, coverage: float = COVERAGE) -> str | None:
    """The text without hit spans, or None if the hits cover more than ``coverage`` of its words.

    Scanning repeats until nothing is found, as words that meet may form a new window.
    """
    text = text or ""
    first = True
    while True:
        hit, _ = automaton.scan(words(text))
        if not hit.any():
            return text
        if first and hit.mean() > coverage:
            return None
        first = False
        text = cut_hits(text, hit)
        if not text:
            return None


def remove_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, length_col: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without benchmark spans, in their own columns; those that a benchmark mostly covers go.

    ``length_col`` is set to the new number of characters where the text changed. With more than one block, each round finds
    the hits of all blocks in the same texts, merges and removes them, as one automaton over all items would.
    """
    blocks = item_blocks(items, item_id_col, item_text_col, block_words)
    first, second = next(blocks, None), next(blocks, None)
    blocks.close()
    if first is None:
        return docs
    if second is None:
        return _remove_block(docs, first, window, text_col, coverage, length_col)
    row, ranges, changed = fresh(docs.columns, "_row"), fresh(docs.columns, "_ranges"), fresh(docs.columns, "_changed")
    left = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    done: list[DataFrame] = []
    while True:
        texts = left.select(F.col(row).alias("_row"), F.col(text_col).alias("_text"))
        passes = [cut_lineage(_match_block(texts, b, ["_row"], "_text", window).where(F.size("hit_words") > 0)) for b in item_blocks(items, item_id_col, item_text_col, block_words)]
        hits = reduce(DataFrame.unionByName, passes).groupBy(F.col("_row").alias(row)).agg(F.array_sort(F.flatten(F.collect_list("hit_words"))).alias(ranges))
        met = left.join(hits.select(row, _union(ranges).alias(ranges)), row, "left").select(*docs.columns, row, ranges)
        out = cut_lineage(_remove_ranges(met, docs, changed, text_col, coverage if not done else 1.0, length_col))
        done.append(out.where(~F.col(changed)).select(*docs.columns))
        left = out.where(F.col(changed)).drop(changed)
        if not left.head(1):
            return reduce(DataFrame.unionByName, done)


def _remove_ranges(met: DataFrame, docs: DataFrame, changed: str, text_col: str, coverage: float, length_col: str | None) -> DataFrame:
    """One round: rows of docs' columns, a number and hit ranges, to docs' columns, the number and whether the text changed."""
    place = docs.columns.index(text_col)
    counted = docs.columns.index(length_col) if length_col else None
    schema = StructType([*met.schema.fields[:-1], StructField(changed, BooleanType())])

    def clean(text: str, ranges: list[dict]) -> str | None:
        hit = np.zeros(len(words(text)), dtype=bool)
        for r in ranges:
            hit[r["start"] : r["end"]] = True
        return None if hit.mean() > coverage else cut_hits(text, hit) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = list(part.columns[:-1])
                old, ranges = columns[place].to_pylist(), part.column(part.num_columns - 1).to_pylist()
                new = [clean(t, r) if r else t for t, r in zip(old, ranges, strict=True)]
                keep = pa.array([not r or t is not None for t, r in zip(new, ranges, strict=True)], pa.bool_())
                columns[place] = pa.array(new, columns[place].type)
                if counted is not None:
                    sizes = [len(t) if r and t is not None else c for c, t, r in zip(columns[counted].to_pylist(), new, ranges, strict=True)]
                    columns[counted] = pa.array(sizes, columns[counted].type)
                columns.append(pa.array([bool(r) for r in ranges], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(keep)

    return met.mapInArrow(run, schema)


def _remove_block(docs: DataFrame, block: list, window: int, text_col: str, coverage: float, length_col: str | None) -> DataFrame:
    place = docs.columns.index(text_col)
    counted = docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built(block, window)
        for batch in batches:
            for part in slices(batch):
                old = part.column(place).to_pylist()
                new = [clean_text(t, automaton, coverage) for t in old]
                keep = pa.array([t is not None for t in new])
                columns = list(part.columns)
                columns[place] = pa.array([o if n == (o or "") else n for o, n in zip(old, new, strict=True)], columns[place].type)
                if counted is not None:
                    columns[counted] = pa.array([c if n is None or n == (o or "") else len(n) for c, o, n in zip(columns[counted].to_pylist(), old, new, strict=True)], columns[counted].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)
