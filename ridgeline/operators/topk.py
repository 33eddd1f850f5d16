"""Ranking within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_per_key(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a rank from 1 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits the groups before the shuffle too."""
    return rank_per_key(df, keys, order, "_place").where(F.col("_place") <= n).drop("_place")


def top_k(scores: DataFrame, k: int, query: str = "qid", doc: str = "docno", score: str = "score") -> DataFrame:
    """The best ``k`` documents of each query, ranked; ties go to the smaller id."""
    return rank_per_key(scores, [query], [F.col(score).desc(), F.col(doc)]).where(F.col("rank") <= k)


def min_max_per_key(df: DataFrame, key: str = "qid", score: str = "score", name: str = "norm") -> DataFrame:
    """Scores scaled to 0..1 within each key; 0 where all are equal."""
    least, most = F.min(score).over(Window.partitionBy(key)), F.max(score).over(Window.partitionBy(key))
    return df.withColumn(name, F.when(most > least, (F.col(score) - least) / (most - least)).otherwise(0.0))
