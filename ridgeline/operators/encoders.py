"""Models as producers of columns: any encoder or generator that maps a batch of texts runs over a table's partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


#: Words whose hashes an encoder remembers.
MOST_WORDS = 50_000


class Encoder(Protocol):
    """Made once in each worker, then called on batches."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEncoder:
    """Counts of hashed words at length 1: a deterministic stand-in for a dense model."""

    def __init__(self, size: int = 64):
        self.size = size
        self.slot = lru_cache(MOST_WORDS)(self.slot)

    def slot(self, word: str) -> tuple[int, int]:
        digest = int.from_bytes(hashlib.md5(word.encode()).digest()[:8])
        return digest % self.size, 1 if digest >> 63 else -1

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size), dtype=np.float64)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                place, sign = self.slot(word)
                row[place] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).astype(np.float32).tolist()


class HashingWords:
    """A unit vector for each word, from its hash: a deterministic stand-in for a multi-vector model."""

    def __init__(self, size: int = 16):
        self.size = size
        self.vector = lru_cache(MOST_WORDS)(self.vector)

    def encode(self, texts: list[str]) -> list[list[list[float]]]:
        return [[self.vector(word) for word in text.lower().split()] for text in texts]

    def vector(self, word: str) -> list[float]:
        digest = hashlib.sha256(word.encode()).digest()
        raw = np.frombuffer((digest * (1 + self.size // 32))[: self.size], dtype=np.uint8).astype(np.float64) - 127.5
        return (raw / np.linalg.norm(raw)).astype(np.float32).tolist()


def _mapped(df: DataFrame, column: str, name: str, kind, make: Callable[[], Callable[[list[str]], list]], arrow: pa.DataType, batch_size: int) -> DataFrame:
    keep = [c for c in df.columns if c != name]
    place = keep.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                values = model([t or "" for t in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow)], names=[*keep, name])

    return df.select(*keep).mapInArrow(run, StructType([df.schema[c] for c in keep] + [StructField(name, kind)]))


def embed(df: DataFrame, column: str, make: Callable[[], Encoder], name: str = "embedding", prefix: str = "", batch_size: int = 256) -> DataFrame:
    """Adds a vector of a text column, with a prefix such as ``query: `` before each text."""

    def load() -> Callable[[list[str]], list]:
        encoder = make()
        return lambda texts: encoder.encode([prefix + t for t in texts])

    return _mapped(df, column, name, ArrayType(FloatType()), load, pa.list_(pa.float32()), batch_size)


def embed_words(df: DataFrame, column: str, make: Callable[[], HashingWords] = HashingWords, name: str = "vecs", batch_size: int = 256) -> DataFrame:
    """Adds a list of vectors of a text column."""

    def load() -> Callable[[list[str]], list]:
        return make().encode

    return _mapped(df, column, name, ArrayType(ArrayType(FloatType())), load, pa.list_(pa.list_(pa.float32())), batch_size)


def generate(df: DataFrame, prompt: str, make: Callable[[], Callable[[list[str]], list[str]]], name: str = "output", batch_size: int = 8) -> DataFrame:
    """Adds what a model answers to a prompt column."""
    return _mapped(df, prompt, name, StringType(), make, pa.string(), batch_size)
