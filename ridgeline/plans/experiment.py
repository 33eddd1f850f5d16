"""Running a matrix of experiments in one session: a document side is scored once, for the queries of all languages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import encoders, fusion, metrics, retrieval
from ridgeline.plans.matrix import Run
from ridgeline.sources.checkpoint import keep
from ridgeline.sources.tables import docs_for_run, queries_for_run, run_frame

Method = Callable[[DataFrame, DataFrame, int], DataFrame]


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return retrieval.bm25(docs, queries, k)


def sparse(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Learned-sparse retrieval with term frequencies for weights."""
    return retrieval.tf_sparse(docs, queries, k)


def dense(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dense retrieval with hashed words for an encoder."""
    return retrieval.dense(encoders.embed(docs, "text", encoders.HashingEncoder), encoders.embed(queries, "query", encoders.HashingEncoder), k)


def multivector(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """MaxSim over the full index with hashed words for an encoder."""
    return retrieval.multi_vector(encoders.embed_words(docs, "text"), encoders.embed_words(queries, "query"), k)


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The candidates of another run by MaxSim with the same encoder."""
    return retrieval.rerank(candidates, encoders.embed_words(queries, "query"), encoders.embed_words(docs, "text"), k)


METHODS: dict[str, Method] = {"bm25": bm25, "sparse": sparse, "dense": dense, "multivector": multivector}
FUSE = {"hybrid_rrf": fusion.reciprocal_rank_fusion, "hybrid_score": fusion.score_fusion, "hybrid_union_candidates": fusion.candidate_union}
CASCADE = "hybrid_cascade"


def execute(
    runs: Iterable[Run], docs: DataFrame, queries: DataFrame, methods: dict[str, Method] | None = None, split: str | None = None, reranker: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] = rerank,
) -> dict[str, DataFrame]:
    """The runs' results by name, with standard columns.

    A method scores a document side for the queries of all languages at once; runs of one language are cut from that. A
    cascade reranks its input run's candidates over both representations joined. What is scored is kept in the checkpoint
    folder, so that fusions and metrics read it. A run whose method or fusion isn't known, or whose input isn't among the
    runs before it, is an error.
    """
    methods = METHODS if methods is None else methods
    every, known = list(runs), set()
    for r in every:
        if not r.inputs and r.method not in methods:
            raise ValueError(f"no such method: {r.method} (of {r.name})")
        if r.inputs and r.representation not in FUSE and r.representation != CASCADE:
            raise ValueError(f"no such fusion: {r.representation} (of {r.name})")
        if lacking := [i for i in r.inputs if i not in known]:
            raise ValueError(f"{r.name} reads runs that aren't there: {lacking}")
        known.add(r.name)
    docs, queries = keep(docs), keep(queries)
    sides: dict[tuple[str, str, str, int], DataFrame] = {}
    langs = sorted({r.query_lang for r in every})
    asked = reduce(DataFrame.unionByName, [queries_for_run(queries, lang, split) for lang in langs])
    lang_of = asked.select("qid", "query_lang").distinct()
    out: dict[str, DataFrame] = {}
    for r in every:
        labels = {"method": r.method, "representation": r.representation, "query_lang": r.query_lang, "doc_lang": r.doc_lang}
        inputs = [out[i] for i in r.inputs]
        if r.representation == CASCADE:
            found = reranker(inputs[0], docs_for_run(docs, "concat", r.doc_lang), queries_for_run(queries, r.query_lang, split), r.k)
            out[r.name] = run_frame(keep(found), **labels)
        elif inputs:
            out[r.name] = run_frame(keep(FUSE[r.representation](*inputs, r.k)), **labels)
        else:
            side = (r.method, r.representation, r.doc_lang, r.k)
            if side not in sides:
                sides[side] = keep(methods[r.method](docs_for_run(docs, r.representation, r.doc_lang), asked, r.k).join(lang_of, "qid"))
            out[r.name] = run_frame(sides[side].where(F.col("query_lang") == r.query_lang).drop("query_lang"), **labels)
    return out


def evaluate(results: dict[str, DataFrame], queries: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Metrics of each query in each run, with the labels that summaries go by.

    All runs are evaluated in one plan, in which judgements come once.
    """
    runs = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("run"), "qid", "docno", "score", "rank") for n, df in results.items()])
    scored = metrics.per_query(runs, qrels, ks, by=("run",))
    part = lambda pattern: F.regexp_extract("run", pattern, 1)
    labelled = scored.withColumns({"method": part("^(.*?)__"), "representation": part("^.*?__(.*)__q"), "query_lang": part("__q([a-z]+)_d"), "doc_lang": part("_d([a-z]+)$")})
    labelled = labelled.withColumn("scenario", F.concat_ws("_to_", "query_lang", "doc_lang"))
    return labelled.join(queries.select("qid", "split", "question_type3").dropDuplicates(["qid"]), "qid", "left")
