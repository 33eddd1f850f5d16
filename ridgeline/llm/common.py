"""Small helpers that the training-data operators share."""

from __future__ import annotations

import base64
import os
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``; only Spark's reader touches the path, so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that the cluster shares.

    The session's ``spark.checkpoint.dir`` is used. Where none is set, a local session, as in tests, takes a folder of its
    own; on a cluster that is an error, as machines don't see each other's folders.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ridgeline-checkpoint-"))
    return df.checkpoint()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(ranks_path: str):
    """Byte-level BPE from a rank file: a path, or the name of a public one, which each worker finds for itself.

    The ids are those of ``byte_bpe_50k.json`` under the tokenizers library (the tests compare them); this reader of
    the same vocabulary needs a quarter of its time. Strings of special tokens in a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path if os.sep in ranks_path else tokenizer_path(ranks_path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_byte_lengths(ranks_path: str) -> np.ndarray:
    """Bytes of each id's token."""
    bpe = byte_bpe(ranks_path)
    return np.array([len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)], dtype=np.int64)


def encode(ranks_path: str, text: str) -> list[int]:
    """Ids of the whole text."""
    return byte_bpe(ranks_path).encode_ordinary(text)


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """What operators take for a vocabulary: the name alone, so that no path of the driver's goes to other machines."""
    return name


def slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that Python holds about ``most`` bytes of it at a time."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, most)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def most_counted(counted: DataFrame, most: int) -> list:
    """Of rows ``(value, n)``, one per value: the values with the largest n, at most ``most``, by falling n and then by value.

    A histogram of n (by eighths of a doubling, so a few hundred rows) says how far down to go; a bucket that would
    exceed ``most`` is left out. So the driver gets no more than it keeps, on any number of partitions.
    """
    counted = cut_lineage(counted.select("value", "n", F.floor(F.log2("n") * 8).cast("int").alias("bucket")))
    sizes = sorted(((r["bucket"], r["count"]) for r in counted.groupBy("bucket").count().collect()), reverse=True)
    least, room = None, most
    for bucket, size in sizes:
        if size > room:
            break
        least, room = bucket, room - size
    if least is None:
        return []
    rows = counted.where(F.col("bucket") >= least).select("value", "n").collect()
    return [r["value"] for r in sorted(rows, key=lambda r: (-r["n"], r["value"]))]


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores put before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
