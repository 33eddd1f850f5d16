"""Packed id matrices: best-fit decreasing with a segment tree over capacities.

Each task encodes its documents, cuts those over a row's length into lossless pieces, and packs blocks of ``block`` tokens.
Pieces of a block go by falling length into the open row with the least room that still holds them; a segment tree over
the capacities 0..row length finds that room in the tree's depth of steps. Packing needs no shuffle, and a task holds one
block of ids at a time. Only the last rows of a block are partly empty, so the padding is a row or so in each block.

A packed row has the id matrix's row (unsigned 16-bit little-endian, or 32-bit where the vocabulary needs it), padded with
``pad_id``; the cumulative segment lengths (0 first, the used length last); and the position resets, which are the offsets
where positions start anew from 0. Segments of one document in different rows are tied by (id, start).

Defined results: null and empty texts give one segment, the end id; repeated rows are packed each on its own; an empty
table gives an empty result. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import encode, slices

ROW = 2048
BLOCK = 4_000_000
END_ID, PAD_ID = 1, 0


class Capacities:
    """Segment tree over room 0..most: which amounts of room have an open row."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            node = self.leaves + room
            while node and not self.any[node]:
                self.any[node] = 1
                node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The least room of ``least`` or more, and a row that has it, which is closed here."""
        node, tree = self.leaves + least, self.any
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node and not (node < self.leaves and (tree[2 * node] or tree[2 * node + 1])):
                tree[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, row: int = ROW) -> list[list[int]]:
    """Rows of piece numbers."""
    rows: list[list[int]] = []
    capacities = Capacities(row)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        if (found := capacities.take(size)) is None:
            room, at = row, len(rows)
            rows.append([])
        else:
            room, at = found
        rows[at].append(k)
        if room > size:
            capacities.put(room - size, at)
    return rows


COLUMNS = "task int, row_no long, used int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, doc_starts array<long>"


def pack(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, block: int = BLOCK, end_id: int = END_ID, pad_id: int = PAD_ID, wide: bool = False) -> DataFrame:
    """Packed rows with COLUMNS; ``wide`` stores 32-bit ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row_no = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        owners: list[tuple[object, int]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row_no
            rows = best_fit_decreasing(np.array([len(p) for p in held]), row)
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                ids, lengths = [], []
                for members in part:
                    flat = np.concatenate([held[k] for k in members])
                    ids.append(np.pad(flat, (0, row - len(flat)), constant_values=pad_id).astype(dtype).tobytes())
                    lengths.append(np.cumsum([0, *(len(held[k]) for k in members)], dtype=np.int32))
                columns = [
                    pa.array([task] * len(part), pa.int32()), pa.array(range(row_no + at, row_no + at + len(part)), pa.int64()), pa.array([int(c[-1]) for c in lengths], pa.int32()), pa.array(ids, pa.binary()),
                    pa.array(lengths, pa.list_(pa.int32())), pa.array([c[:-1] for c in lengths], pa.list_(pa.int32())),
                    pa.array([[owners[k][0] for k in members] for members in part], pa.list_(id_type)), pa.array([[owners[k][1] for k in members] for members in part], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["task", "row_no", "used", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"])
            row_no += len(rows)
            held.clear()
            owners.clear()

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, 4 << 20):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(ranks, text or ""), end_id], dtype=dtype)
                    for start in range(0, len(ids), row):
                        held.append(ids[start : start + row])
                        owners.append((key, start))
                    tokens += len(ids)
                    if tokens >= block:
                        yield from flush()
                        tokens = 0
        if held:
            yield from flush()

    return docs.select(id_col, text_col).mapInArrow(run, COLUMNS.format(kind=kind))


def unpack(packed: DataFrame, wide: bool = False) -> DataFrame:
    """The segments again: ``(doc_id, start, ids)`` with ids as stored bytes."""
    width = 4 if wide else 2
    seg = packed.select("ids", F.posexplode("doc_ids").alias("k", "doc_id"), "cu_seqlens", "doc_starts")
    begin, end = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    raw = F.substring("ids", begin * width + 1, (end - begin) * width)
    return seg.select("doc_id", F.element_at("doc_starts", F.col("k") + 1).alias("start"), raw.alias("ids"))


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: one binary matrix row each, with its segment columns."""
    packed.write.mode("overwrite").parquet(path)
