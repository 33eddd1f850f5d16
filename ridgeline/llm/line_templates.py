"""Line dedup by a log-template tree.

Texts are cut into units: lines, and within lines sentences, so that a passage is found in whatever line it stands. Every
unit is parsed down a tree of fixed depth: first the number of its tokens, then its ``leading`` first tokens, tokens with
digits standing for any value. The leaf generalises variable fields: the remaining tokens of a longer unit are cut into two
stretches, and the unit belongs to two templates, each with one stretch left open; shorter units have one template. Two
units of a leaf so share a template if all their differences lie in fields with digits and in one stretch. Templates don't
depend on the order of units, so the tree needs no sequential pass and no shared state: a template is a 64-bit hash and
recurrence a count. (Two templates among n share a hash by chance about n / 2 ** 64 times: 5e-9 at n = 1e11.)

A template that occurs in ``least_docs`` documents or more is recurring, in all documents but the one with the smallest
id, which keeps it. Recurring units that follow each other make a run. Units too short for a template (under
``least_tokens``) recur with their neighbours: if the unit and the one before it, or the one after it, stand together in other
documents. What doesn't recur of them joins a run only up to ``MOST_GAP`` words and ``GAP_BYTES`` bytes between two recurring
units, so that short lines of a document's own stay. A run is dropped if it has ``least_run`` words or more, or if it fills
whole lines: short sentences that meet by chance in otherwise different lines stay. Counting pre-aggregates, and templates
with many occurrences are salted where occurrences meet their counts, so a line that a third of all documents have doesn't
meet in one task.

Defined results: null and empty texts have no units and stay as they are; a text without a dropped run stays to the byte;
rows with the same id are one document; a null id comes first. A document all of whose units are dropped has the empty
text. An empty table gives an empty one. Extra columns are carried along, whatever their names, but for ``n_lines`` and
``n_dropped``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ridgeline.llm.common import cut_lineage, fresh, slices

LEADING, LEAST_TOKENS, STRETCH_FROM, LEAST_DOCS, LEAST_RUN = 2, 4, 12, 2, 20
#: Most words and bytes of short units that needn't recur between two recurring ones.
MOST_GAP, GAP_BYTES = 8, 64
ANY = b"<*>"
_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))
#: What parts units: one blank after a sentence's end, and a line break.
_BREAK = re.compile(rb"((?<=[.!?]) |\n)")


def units(text: str | None) -> list[bytes]:
    """Units and what follows each, in turn; joined they are the text."""
    parts = _BREAK.split((text or "").encode("utf-8", "surrogatepass"))
    parts.append(b"")
    return parts


def plain_units(raw: bytes) -> list[bytes]:
    """The same units alone; replacing is some times faster than the pattern."""
    return raw.replace(b". ", b".\n").replace(b"! ", b"!\n").replace(b"? ", b"?\n").split(b"\n")


def distinct_units(raw: bytes) -> set[bytes]:
    """The same units, each once."""
    return set(plain_units(raw))


def shapes(tokens: list[bytes], leading: int = LEADING, stretch_from: int = STRETCH_FROM) -> tuple[bytes, ...]:
    """The templates of a unit's tokens, those with digits already masked."""
    n = len(tokens)
    rest = n - leading
    if rest < stretch_from:
        return (b"%d|" % n + b" ".join(tokens),)
    half = leading + rest // 2
    return b"%d|1|" % n + b" ".join(tokens[:half]), b"%d|2|" % n + b" ".join(tokens[:leading] + tokens[half:])


def masked(tokens: list[bytes]) -> list[bytes]:
    return [ANY if b"0" in t.translate(_DIGITS) else t for t in tokens]


def templates(unit: bytes, leading: int = LEADING, least_tokens: int = LEAST_TOKENS, stretch_from: int = STRETCH_FROM) -> list[bytes]:
    """The templates of a unit; none if it is too short."""
    tokens = unit.split()
    return [] if len(tokens) < least_tokens else list(shapes(masked(tokens), leading, stretch_from))


def unit_hash(unit: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(unit) - (1 << 63)


def beside(before: bytes, after: bytes) -> bytes:
    """The key of two units that follow each other."""
    return b"+|" + before.strip() + b"\n" + after.strip()


def short_pairs(lines: list[bytes], sizes: dict[bytes, int], least_tokens: int = LEAST_TOKENS) -> set[bytes]:
    """The keys of neighbours of which one is short, blank units aside, where short ones in turn are more than a gap may have."""
    filled = [u for u in lines if sizes[u]]
    marks = [sizes[u] < least_tokens for u in filled]
    out: set[bytes] = set()
    end = 0
    while True in marks[end:]:
        start = marks.index(True, end)
        end = marks.index(False, start) if False in marks[start:] else len(marks)
        part = filled[start:end]
        if sum(map(sizes.__getitem__, part)) > MOST_GAP or sum(map(len, part)) > GAP_BYTES:
            near = filled[max(start - 1, 0) : end + 1]
            out.update(map(beside, near, near[1:]))
    return out


def unit_keys(docs: DataFrame, id_col: str, text_col: str, leading: int = LEADING, least_tokens: int = LEAST_TOKENS, stretch_from: int = STRETCH_FROM) -> DataFrame:
    """``(id, unit, key)``: a hash of each distinct unit of a row, and of each of its templates.

    For neighbours of which one is short, both are the hash of the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        middle = 1 << 63
        for batch in batches:
            for part in slices(batch, 2 << 20):
                take, own, keys = [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    digits = b"0" in raw.translate(_DIGITS)
                    lines = plain_units(raw)
                    sizes: dict[bytes, int] = {}
                    few = False
                    for unit in set(lines):
                        tokens = unit.split()
                        sizes[unit] = len(tokens)
                        if len(tokens) < least_tokens:
                            few = True
                            continue
                        hashed = digest(unit) - middle
                        for shape in shapes(masked(tokens) if digits else tokens, leading, stretch_from):
                            take.append(k)
                            own.append(hashed)
                            keys.append(digest(shape) - middle)
                    for hashed in {digest(pair) - middle for pair in short_pairs(lines, sizes, least_tokens)} if few else ():
                        take.append(k)
                        own.append(hashed)
                        keys.append(hashed)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), pa.array(own, pa.int64()), pa.array(keys, pa.int64())], names=["id", "unit", "key"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, unit long, key long")


def recurring(keys: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(key, owner, rows)`` of the templates in ``least_docs`` documents or more; owner: the smallest id, rows: occurrences."""
    nulls = F.max(F.col("id").isNull()).alias("has_null")
    if least_docs == 2:
        counted = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows"), nulls)
        many = (F.col("least") != F.col("most")) | (F.col("has_null") & F.col("least").isNotNull())
    else:
        counted = keys.groupBy("key", "id").agg(F.count("*").alias("r")).groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.sum("r").alias("rows"), nulls)
        many = F.col("n") >= least_docs
    return counted.where(many).select("key", F.when(~F.col("has_null"), F.col("least")).alias("owner"), "rows")


#: A template with more occurrences than HEAVY, and than one in MOST_HEAVY of all, is dealt to SALTS tasks; so there are fewer
#: than MOST_HEAVY such templates (8 bytes each), which are sent to every task.
HEAVY, MOST_HEAVY, SALTS = 10_000, 20_000, 64


def met_keys(keys: DataFrame, found: DataFrame, heavy: int = HEAVY, salts: int = SALTS) -> DataFrame:
    """``(id, unit)`` of the keys that are found, in all documents but the owner; a key of any size meets in many tasks."""
    found = cut_lineage(found)
    total = found.agg(F.sum("rows")).first()[0] or 0
    large = F.col("rows") > max(heavy, total // MOST_HEAVY)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(large, salts - 1).otherwise(0)))).drop("rows")
    dealt = keys.join(F.broadcast(found.where(large).select("key", F.lit(True).alias("large"))), "key", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("large"), F.pmod(F.xxhash64("id", "unit"), F.lit(salts)).cast("int")).otherwise(0)).drop("large")
    return dealt.join(salted, ["key", "salt"]).where(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "unit")


def _whole_lines(parts: list[bytes], start: int, end: int) -> bool:
    """Nothing but blanks stands before or after the range in its lines."""
    a, n = 2 * start - 1, len(parts)
    while a > 0 and parts[a] != b"\n":
        if parts[a - 1].strip():
            return False
        a -= 2
    b = 2 * end - 1
    while b < n - 1 and parts[b] != b"\n":
        if parts[b + 1].strip():
            return False
        b += 2
    return True


def dropped_runs(parts: list[bytes], gone: set[int], least_tokens: int = LEAST_TOKENS, least_run: int = LEAST_RUN) -> list[tuple[int, int]]:
    """Ranges of units (start, end) to drop, given the hashes of the recurring ones."""
    n = len(parts) // 2
    sizes = [len(parts[2 * k].split()) for k in range(n)]
    recurs = [sizes[k] >= least_tokens and unit_hash(parts[2 * k]) in gone for k in range(n)]
    filled = [k for k in range(n) if sizes[k]]
    shared = [False] * n  # short units that recur with a neighbour
    for a, b in pairwise(filled):
        if (sizes[a] < least_tokens or sizes[b] < least_tokens) and unit_hash(beside(parts[2 * a], parts[2 * b])) in gone:
            shared[a], shared[b] = shared[a] or sizes[a] < least_tokens, shared[b] or sizes[b] < least_tokens
    runs, k = [], 0
    while k < n:
        if not recurs[k]:
            k += 1
            continue
        end = last = k + 1
        words = held = 0
        while end < n and (recurs[end] or sizes[end] < least_tokens):
            if recurs[end]:
                words = held = 0
                last = end + 1
            elif not shared[end]:
                words, held = words + sizes[end], held + len(parts[2 * end].strip())
                if words > MOST_GAP or held > GAP_BYTES:
                    break
            end += 1
        if sum(sizes[k:last]) >= least_run or _whole_lines(parts, k, last):
            runs.append((k, last))
        k = max(end, last)
    return runs


def without(parts: list[bytes], runs: list[tuple[int, int]]) -> str:
    """The text without some ranges of units. A line break that goes with a range stays where text stays before it."""
    kept: list[bytes] = []
    at = 0
    for start, end in runs:
        kept += parts[2 * at : 2 * start]
        if kept and b"\n" not in kept[-1] and any(b"\n" in s for s in parts[2 * start + 1 : 2 * end : 2]):
            kept[-1] = b"\n"
        at = end
    kept += parts[2 * at :]
    if at == len(parts) // 2 and kept:  # the text's end went
        kept[-1] = b""
    return b"".join(kept).decode("utf-8", "surrogatepass")


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_run: int = LEAST_RUN, length_col: str | None = None, least_tokens: int = LEAST_TOKENS, **rules: int) -> DataFrame:
    """The documents, in their own columns, with changed texts, and ``n_lines`` (before) and ``n_dropped`` (units)."""
    keys = unit_keys(docs, id_col, text_col, least_tokens=least_tokens, **rules)
    found = recurring(keys, least_docs)
    own, drop = fresh(docs.columns, "_id"), fresh(docs.columns, "_drop")
    dropped = met_keys(keys, found).groupBy(F.col("id").alias(own)).agg(F.collect_set("unit").alias(drop))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    met = docs.select(*keep).join(dropped, docs[id_col].eqNullSafe(dropped[own]), "left").select(*keep, drop)
    place, counted = keep.index(text_col), keep.index(length_col) if length_col else None
    schema = StructType([docs.schema[c] for c in keep] + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = list(part.columns[: len(keep)])
                texts, lengths, n_lines, n_dropped = [], [], [], []
                olds = columns[place].to_pylist()
                sizes = columns[counted].to_pylist() if counted is not None else [None] * len(olds)
                for text, gone, size in zip(olds, part.column(len(keep)).to_pylist(), sizes, strict=True):
                    runs, lines = [], text.count("\n") + 1 if text else 0
                    if gone and (runs := dropped_runs(parts := units(text), set(gone), least_tokens, least_run)):
                        text = without(parts, runs)
                        size = len(text)
                    texts.append(text)
                    lengths.append(size)
                    n_lines.append(lines)
                    n_dropped.append(sum(b - a for a, b in runs))
                columns[place] = pa.array(texts, columns[place].type)
                if counted is not None:
                    columns[counted] = pa.array(lengths, columns[counted].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return met.mapInArrow(run, schema)
