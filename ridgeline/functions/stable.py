"""Choices that are random-looking but the same on every run, machine and partitioning."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def seeded_md5(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}::"), key))


def hex_mod(digest: Column, n: Column) -> Column:
    """A 128-bit hexadecimal number modulo n, digit by digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))).cast("long") - 1)
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % n.cast("long"))


def stable_index(key: Column, n: Column, seed: int = 42) -> Column:
    """An index from 0 to n - 1; null where n is 0."""
    return F.when(n > 0, hex_mod(seeded_md5(key, seed), F.greatest(n, F.lit(1))).cast("int"))


def stable_choice(items: Column, key: Column, seed: int = 42) -> Column:
    """One item of an array; null for an empty one."""
    return F.get(items, stable_index(key, F.size(items), seed))


def stable_order(key: Column, seed: int = 42) -> Column:
    """A value to order by for a reproducible sample."""
    return seeded_md5(key, seed)


@F.pandas_udf(ArrayType(StringType()))
def mixed_pattern(base_ids: pd.Series, sizes: pd.Series, seeds: pd.Series) -> pd.Series:
    """The language, en or es, of each place of a mixed set of triples.

    Half of the places each; for odd sizes a coin gives the extra one. Python's generator, seeded by md5, is needed to
    choose the very same places as earlier collections have.
    """

    def one(base_id: str, n: int, seed: int) -> list[str] | None:
        if base_id is None or n != n:
            return None
        rng = random.Random(int(hashlib.md5(f"{seed}::mix::{base_id}".encode()).hexdigest(), 16) % 2**32)
        n = int(n)
        n_en = n // 2 + (n % 2 and rng.random() < 0.5)
        english = set(rng.sample(range(n), n_en))
        return ["en" if k in english else "es" for k in range(n)]

    return pd.Series([one(b, n, s) for b, n, s in zip(base_ids, sizes, seeds, strict=True)], dtype=object)


def mixed_pattern_by_hash(base_id: Column, size: Column, seed: int = 42) -> Column:
    """The same split by built-in functions alone: places in order of their hash, the first half English.

    The extra place of an odd size is English where the hash of the id ends in an even digit.
    """
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    ranked = F.transform(F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat(F.lit(f"{seed}::"), base_id, F.lit("::"), i.cast("string"))).alias("h"), i.alias("i")))), lambda x: x["i"])
    extra = F.when((size % 2 == 1) & F.substring(F.md5(F.concat(F.lit(f"{seed}::"), base_id)), 32, 1).isin(*"02468ace"), 1).otherwise(0)
    english = F.slice(ranked, F.lit(1), F.floor(size / 2).cast("int") + extra)
    return F.transform(places, lambda i: F.when(F.array_contains(english, i), "en").otherwise("es"))
