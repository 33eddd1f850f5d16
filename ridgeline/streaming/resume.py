"""Batches that can be resumed: what is done is read from the output itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.tables import exists


def todo(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose key isn't done yet; nulls match nulls."""
    mine = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    met = F.lit(True)
    for k in keys:
        met = met & tasks[k].eqNullSafe(mine[f"_{k}"])
    return tasks.join(mine, met, "left_anti")


def run_resumable(tasks: DataFrame, keys: list[str], path: str, step: Callable[[DataFrame], DataFrame], batches: int = 1) -> int:
    """Appends the step's rows for the open tasks to a Parquet folder, in batches by hash of the key; gives the batches written.

    Each batch is one commit, so a run that breaks off loses at most a batch, and a finished run does nothing again.
    """
    spark = tasks.sparkSession
    written = 0
    for k in range(batches):
        part = tasks.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k) if batches > 1 else tasks
        if exists(spark, path):
            part = todo(part, spark.read.parquet(path), keys)
        if part.head(1):
            step(part).write.mode("append").parquet(path)
            written += 1
    return written


class Profile:
    """Wall times of stages, and the derived rates of a run."""

    def __init__(self, **labels: object):
        self.row: dict[str, object] = dict(labels)
        self.begun = time.time()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.time()
        try:
            yield
        finally:
            self.row[f"{name}_time_s"] = float(self.row.get(f"{name}_time_s", 0.0)) + time.time() - start

    def finish(self, **counts: int) -> dict[str, object]:
        total = time.time() - self.begun
        self.row |= counts | {"total_time_s": total}
        for name in ("docs", "queries"):
            n = counts.get(f"n_{name}")
            self.row[f"{name}_per_second_total"] = n / total if n and total > 0 else None
        return self.row
