"""Sequence packing by non-negative least squares over the histogram of lengths.

Documents are encoded, closed with an end id and cut into pieces: whole windows, and one rest shorter than a window. A whole
window is a sequence of its own. For the rests, lengths are rounded up to units of ``unit`` tokens; all ways of filling a
window with at most ``depth`` lengths are enumerated (shallow combinations), and non-negative least squares gives how often
to use each so that the histogram is used up. Repeat counts are rounded and held to what the histogram has; what is left
over is packed greedily, best fit decreasing, on the histogram. The programme depends on the number of units only, never on
the number of documents: the driver holds one histogram of ``window / unit`` bins.

The plan is then applied at scale. A rest gets its number among the rests of the same length from its task's own counts and
the sums over earlier tasks, so no length, however common, meets in one task; the number picks the plan's slot. Only
lengths and checksums are moved, never ids.

Defined results: null and empty texts give one piece, the end id; repeated rows are packed each on its own; an empty table
gives an empty result. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import cut_lineage, encode, slices

WINDOW, UNIT, DEPTH = 2048, 8, 3
END_ID = 1


def pieces(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """One row per piece ``(id, start, length, ids_crc32, doc_tokens, task, units, number)``.

    ``number`` counts the pieces of the same units in the same task, from 0.
    """
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "task", "units", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = [0] * (window // unit + 2)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                take, rows = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(ranks, text or ""), end_id], dtype="<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        units = -(-len(piece) // unit)
                        take.append(k)
                        rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, units, seen[units]))
                        seen[units] += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways, largest first, to write ``units`` as a sum of at most ``depth`` lengths."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, so_far: tuple[int, ...]) -> None:
        room = depth - len(so_far)
        if not left:
            out.append(so_far)
            return
        for size in range(min(left, most), (left - 1) // room if room else left, -1):
            grow(left - size, size, (*so_far, size))

    grow(units, units, ())
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, most_steps: int = 1500, tolerance: float = 1e-7) -> np.ndarray:
    """min |matrix x - target| over x >= 0 by the active-set method of Lawson and Hanson."""
    n = matrix.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(matrix.T @ target).max(initial=0)))
    for _ in range(most_steps):
        slope = matrix.T @ (target - matrix @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tolerance * scale:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(matrix[:, at], target, rcond=1e-10)[0]
            if solved.min() > 0:
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            old = x[at]
            if old[low].max(initial=0) <= 0:  # a column that can't move is left out again
                free[at[low]] = False
                if not free.any():
                    break
                continue
            step = np.min(old[low] / np.maximum(old[low] - solved[low], 1e-30))
            x[at] = old + step * (solved - old)
            gone = at[(x[at] <= 1e-12) & low]
            x[gone], free[gone] = 0, False
    return x


def solve(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, repeats) that use the histogram of lengths up exactly."""
    left = np.zeros(units + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    used = np.flatnonzero(left)
    plan: list[tuple[tuple[int, ...], int]] = []
    fills = [c for c in combinations(units, depth) if all(left[s] for s in c)]
    if fills and len(used) > 1:
        row = {int(s): k for k, s in enumerate(used)}
        matrix = np.zeros((len(used), len(fills)))
        for j, fill in enumerate(fills):
            for s in fill:
                matrix[row[s], j] += 1
        # Long lengths must not be left over, as they fit with little else: they weigh more.
        weight = 0.1 + used / units
        x = nnls(matrix * weight[:, None], left[used] * weight)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            need = np.bincount(fills[j], minlength=units + 1)
            repeats = min(round(x[j]), *(int(left[s] // need[s]) for s in set(fills[j])))
            if repeats > 0:
                left -= repeats * need
                plan.append((fills[j], repeats))
    return plan + best_fit(left, units)


def best_fit(left: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Greedy packing on the histogram: the longest length left, then the longest that still fits; repeated while it lasts."""
    left, plan = left.copy(), []
    while left.any():
        room, fill, rest = units, [], left.copy()
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            size = int(fits[-1])
            fill.append(size)
            rest[size] -= 1
            room -= size
        need = np.bincount(fill, minlength=units + 1)
        repeats = int(np.min(left[need > 0] // need[need > 0]))
        left -= repeats * need
        plan.append((tuple(fill), repeats))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (units, first number, count, first sequence, slot): which numbers of a length go to which place."""
    rows, taken, sequence = [], {}, 0
    for fill, repeats in plan:
        for slot, size in enumerate(fill):
            first = taken.get(size, 0)
            rows.append((size, first, repeats, sequence, slot))
            taken[size] = first + repeats
        sequence += repeats
    return rows


def pack(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end_id: int = END_ID) -> DataFrame:
    """Per piece ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    every = cut_lineage(pieces(docs, ranks, id_col, text_col, window, end_id, unit))
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # The numbers of a length in earlier tasks; a row for each task and length, however long the table is.
    by_task = every.where(F.col("length") < window).groupBy("task", "units").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("units").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("task", "units", "n", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["units"]: r["n"] for r in by_task.groupBy("units").agg(F.sum("n").alias("n")).collect()}  # at most window / unit rows
    full_units = window // unit
    # Rests that round up to a whole window are alone too; their numbers count among the whole windows' otherwise.
    plan = solve({u: n for u, n in counts.items() if u < full_units}, full_units, depth)
    places = slots(plan)
    by_units: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {p[0] for p in places}:
        own = [p for p in places if p[0] == size]
        by_units[size] = tuple(np.array(c, dtype=np.int64) for c in zip(*[(p[1], p[3], p[4]) for p in own], strict=True))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, number = np.asarray(batch.column(5)), np.asarray(batch.column(6))
            sequence, slot = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
            for u in np.unique(units).tolist():
                at = np.flatnonzero(units == u)
                first, base, places_of = by_units[u]
                k = np.searchsorted(first, number[at], side="right") - 1
                sequence[at] = base[k] + number[at] - first[k]
                slot[at] = places_of[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], names=[*out[:5], "sequence", "slot"])

    kind = docs.schema[id_col].dataType.simpleString()
    is_rest = F.col("units") < full_units
    numbered = every.where(is_rest).join(by_task.select("task", "units", "before"), ["task", "units"]).select(*out[:5], "units", (F.col("number") + F.col("before")).alias("number"))
    placed = numbered.mapInArrow(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence long, slot long")
    above = F.sum("length").over(Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    rests = placed.withColumn("offset", F.coalesce(above, F.lit(0))).withColumn("sequence_id", F.col("sequence") * 2)
    whole = every.where(~is_rest).withColumn("sequence_id", (F.col("task") * F.lit(1 << 31) + F.col("number")) * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return rests.select(*out).unionByName(whole.select(*out))


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, and the padding that fills them up to ``window`` (none at a power of two)."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.expr("bit_count(used) = 1")
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.when(power, 0).otherwise(F.lit(window) - F.col("used"))).alias("padding"))
