"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import byte_cnn, decontaminate, line_templates, nnls_packing, simhash_dedup
from ridgeline.llm.common import cut_lineage, ranks_path, table
from ridgeline.workers import make_importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return byte_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first.

    Documents go too that lose lines and keep less than a line's least number of words, and not many characters, as scripts
    without blanks do: all they had is elsewhere.
    """
    kept = line_templates.drop_templates(docs, length_col="n_chars")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    emptied = (F.col("n_dropped") > 0) & (words < line_templates.LEAST_TOKENS) & (F.length(F.trim("text")) < line_templates.GAP_BYTES)
    return kept.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts with five-word shingles of similarity 0.8, or near fingerprints."""
    return simhash_dedup.keep_first(docs, similarity=simhash_dedup.SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items go; documents that are mostly benchmark go."""
    return decontaminate.remove_items(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, and their places in sequences."""
    return nnls_packing.pack(docs, ranks_path())


def _stage(f: Stage) -> Stage:
    """The stage, with this checkout on the path of the Python workers that it starts."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        make_importable(spark)
        return f(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _stage(f)) for name, f in (("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing))]

#: SQL can express neither the network nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
