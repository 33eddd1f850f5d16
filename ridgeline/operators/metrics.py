"""Retrieval metrics per query, and summaries over every combination of their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.topk import first_per_key, rank_per_key

DIMENSIONS = ("query_lang", "doc_lang", "scenario", "split", "question_type3")
DIGITS = 9


def judged(qrels: DataFrame) -> DataFrame:
    """``(qid, docno)`` of the relevant pairs, once each."""
    return qrels.where(F.col("relevance") > 0).select("qid", "docno").distinct()


def dedupe_run(run: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each pair at its best rank, and its place among what is left; ``by`` tells several runs apart."""
    once = first_per_key(run, [*by, "qid", "docno"], [F.col("rank"), F.col("score").desc()])
    return rank_per_key(once, [*by, "qid"], [F.col("rank"), F.col("docno")], "place")


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10), include_unretrieved: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``(qid, n_relevant, AP, Recall@k, P@k, nDCG@k, MRR@k)`` for judged queries that the run has (or for all judged).

    ``by`` names columns that tell several runs apart; their judgements are the same, and are counted once for all.
    """
    relevant = judged(qrels)
    if include_unretrieved and by:
        raise ValueError("unretrieved queries are those of one run")
    if not include_unretrieved:
        relevant = relevant.join(run.select("qid").distinct(), "qid", "left_semi")
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    placed = dedupe_run(run.select(*by, "qid", "docno", "score", "rank"), by)
    # Judgements may be many more than what a run has
    found = relevant.join(run.select("qid", "docno").distinct(), ["qid", "docno"], "left_semi")
    marked = placed.join(found.withColumn("rel", F.lit(1)), ["qid", "docno"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hits = F.sum("rel").over(Window.partitionBy(*by, "qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = marked.withColumn("hits", hits).join(n, "qid", "right" if include_unretrieved else "inner")
    rel, place, total = F.coalesce("rel", F.lit(0)), F.col("place"), F.col("n_relevant")
    sums = [F.sum(F.when(rel == 1, F.col("hits") / place).otherwise(0.0)).alias("_ap")]
    for k in ks:
        near = (rel == 1) & (place <= k)
        sums += [F.sum(near.cast("int")).alias(f"_h{k}"), F.sum(F.when(near, 1 / F.log2(place + 1)).otherwise(0.0)).alias(f"_g{k}"), F.min(F.when(near, place)).alias(f"_f{k}")]
    summed = met.groupBy(*by, "qid", "n_relevant").agg(*sums)
    out = [*map(F.col, by), F.col("qid"), F.col("n_relevant"), F.round(F.col("_ap") / total, DIGITS).alias("AP")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(total, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        hit = F.coalesce(f"_h{k}", F.lit(0))
        out += [F.round(hit / total, DIGITS).alias(f"Recall@{k}"), F.round(hit / F.lit(k), DIGITS).alias(f"P@{k}"), F.round(F.coalesce(f"_g{k}", F.lit(0.0)) / ideal, DIGITS).alias(f"nDCG@{k}"), F.round(F.coalesce(1 / F.col(f"_f{k}"), F.lit(0.0)), DIGITS).alias(f"MRR@{k}")]
    return summed.select(*out)


def metric_columns(ks: tuple[int, ...] = (5, 10)) -> list[str]:
    return ["AP", *[f"{m}@{k}" for k in ks for m in ("Recall", "P", "nDCG", "MRR")]]


def summarize(metrics: DataFrame, keys: list[str], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Means by key, nulls kept as a key, and the number of queries."""
    return metrics.groupBy(*keys).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("n_relevant", *metric_columns(ks))])


def summary_cube(metrics: DataFrame, keys: tuple[str, ...] = ("method", "representation"), dimensions: tuple[str, ...] = DIMENSIONS, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Means for each method and representation, over all 32 subsets of the dimensions; ALL stands for what is rolled up."""
    sets = [[d for i, d in enumerate(dimensions) if mask >> i & 1] for mask in range(1 << len(dimensions))]
    cube = metrics.groupingSets([[F.col(c) for c in (*keys, *s)] for s in sets], *[F.col(c) for c in (*keys, *dimensions)])
    rolled = cube.agg(*[F.grouping(d).alias(f"_{d}") for d in dimensions], F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("n_relevant", *metric_columns(ks))])
    return rolled.select(*keys, *[F.when(F.col(f"_{d}") == 1, "ALL").otherwise(F.col(d)).alias(d) for d in dimensions], "n_queries", "n_relevant", *[F.col(f"`{c}`") for c in metric_columns(ks)])
