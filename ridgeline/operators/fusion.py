"""Fusing a triples run and a text run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.retrieval import rerank
from ridgeline.operators.topk import first_per_key, min_max_per_key, top_k

MISSING_RANK = 1e9
DIGITS = 9


def paired(triples: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``(qid, docno, t, x)``: a column of both runs, null where a run lacks the pair."""
    return triples.select("qid", "docno", F.col(column).alias("t")).join(texts.select("qid", "docno", F.col(column).alias("x")), ["qid", "docno"], "full")


def reciprocal_rank_fusion(triples: DataFrame, texts: DataFrame, k: int = 100, smoothing: float = 60.0, triples_weight: float = 0.5, text_weight: float = 0.5) -> DataFrame:
    """Weighted reciprocal ranks; a missing pair has a very late rank."""
    met = paired(triples, texts, "rank")
    part = lambda c, w: w / (smoothing + F.coalesce(F.col(c).cast("double"), F.lit(MISSING_RANK)))
    return top_k(met.select("qid", "docno", F.round(part("t", triples_weight) + part("x", text_weight), DIGITS).alias("score")), k)


def score_fusion(triples: DataFrame, texts: DataFrame, k: int = 100, triples_weight: float = 0.5, text_weight: float = 0.5) -> DataFrame:
    """Weighted scores, each run scaled to 0..1 per query; a missing pair has 0."""
    met = paired(min_max_per_key(triples), min_max_per_key(texts), "norm")
    score = triples_weight * F.coalesce("t", F.lit(0.0)) + text_weight * F.coalesce("x", F.lit(0.0))
    return top_k(met.select("qid", "docno", F.round(score, DIGITS).alias("score")), k)


def candidate_union(triples: DataFrame, texts: DataFrame, k: int = 1000, depth: int = 1000) -> DataFrame:
    """The pairs of both runs, each with its better-ranked row (triples on a tie), ranked anew by raw score."""
    tagged = [run.where(F.col("rank") <= depth).select("qid", "docno", "score", "rank", F.lit(i).alias("source")) for i, run in enumerate((triples, texts))]
    kept = first_per_key(tagged[0].unionByName(tagged[1]), ["qid", "docno"], [F.col("rank"), F.col("source")])
    return top_k(kept.select("qid", "docno", "score"), k)


def cascade(triples: DataFrame, texts: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10, depth: int = 100) -> DataFrame:
    """The union's first ``depth`` candidates, reranked by multi-vectors."""
    return rerank(candidate_union(triples, texts, depth), queries, docs, k, depth)


def unanimous(values: Column, otherwise: str) -> Column:
    """An aggregate: the only value there is, or a name for several or none."""
    found = F.collect_set(values)
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(otherwise)


def fused_labels(triples: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: method, query language and document language of a fused run."""
    both = triples.select("method", "query_lang", F.lit(None).cast("string").alias("doc_lang")).unionByName(texts.select("method", "query_lang", "doc_lang"))
    return both.agg(unanimous(F.col("method"), "hybrid").alias("method"), unanimous(F.col("query_lang"), "mixed").alias("query_lang"), unanimous(F.col("doc_lang"), "mixed").alias("doc_lang"))
