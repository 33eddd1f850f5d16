"""Questions to queries and relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.text import normalise_triple, normalize_ws, qtype3, query_id_base, split_triples, text_or_empty
from ridgeline.sources.checkpoint import keep

#: Questions' triples that may be sent to every task; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def filter_questions(qa: DataFrame, statuses: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """Questions of the given states and splits; None or ["ALL"] takes all."""
    for column, wanted in (("validation_status", statuses), ("split", splits)):
        if wanted and [w.upper() for w in wanted] != ["ALL"]:
            qa = qa.where(F.col(column).isin(*wanted))
    return qa


def triple_docs(docs: DataFrame, supporting: str = "supporting_mtriples_en", raw: str = "triples_en_raw", more: tuple[str, ...] = ("n_triples",)) -> DataFrame:
    """``(triple, docno, ...)``: the facts of each document; the raw triples stand in for missing supporting ones."""
    field = F.when(F.trim(text_or_empty(F.col(supporting))) != "", F.col(supporting)).otherwise(F.col(raw) if raw in docs.columns else F.lit(""))
    # Joined fields of several rows are one per line
    parts = F.flatten(F.transform(F.split(field, "\n"), split_triples))
    return docs.select("docno", *more, F.explode(F.array_distinct(parts)).alias("triple"))


def relevant_docs(qa: DataFrame, facts: DataFrame, min_triples: int = 1) -> DataFrame:
    """``(qa_row_id, docno)`` for questions with some relevant document of ``min_triples`` or more triples.

    The facts that some question asks for are kept; the questions' triples are sent to the tasks after their number was
    checked, so that a triple of many documents doesn't come to one task.
    """
    asked = qa.select("qa_row_id", normalize_ws(F.col("mtriple")).alias("triple"))
    sent = F.broadcast if asked.count() <= MOST_BROADCAST else (lambda df: df)
    if min_triples > 1:
        facts = keep(facts.select("triple", "docno", "n_triples").join(sent(asked.select("triple").distinct()), "triple", "left_semi"))
        most = facts.groupBy("triple").agg(F.max("n_triples").alias("most"))
        # A question that comes with several triples fits by any of them
        fits = asked.join(most, "triple").where(F.col("most") >= min_triples).select("qa_row_id").distinct()
        asked = asked.join(fits, "qa_row_id", "left_semi")
    return facts.select("triple", "docno").join(sent(asked), "triple").select("qa_row_id", "docno").distinct()


def queries_long(qa: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per question and language with a text; ``columns`` maps languages to question columns."""
    kind = qtype3(F.col("selected_role"), F.col("question_type"))
    base = qa.withColumn("question_type3", kind)
    base = base.withColumn("query_id_base", query_id_base(*[F.col(c) for c in ("qa_row_id", "split", "category", "eid", "lex_id", "question_idx", "question_type3")]))
    each = F.explode(F.array(*[F.struct(F.lit(lang).alias("query_lang"), normalize_ws(F.col(c)).alias("query")) for lang, c in columns.items()]))
    out = base.withColumn("q", each).select("*", "q.query_lang", "q.query").drop("q").where("query <> ''")
    return out.withColumn("qid", F.concat_ws("__", "query_id_base", "query_lang"))


def project_qrels(queries: DataFrame, relevant: DataFrame, drop_unjudged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Queries and ``(qid, docno, relevance)``; queries without a relevant document go unless they are to stay."""
    qrels = queries.select("qid", "qa_row_id").join(relevant, "qa_row_id").select("qid", "docno", F.lit(1).alias("relevance")).distinct()
    kept = queries.join(qrels.select("qid").distinct(), "qid", "left_semi") if drop_unjudged else queries
    return kept, qrels


QA_IDENTITY = ("split", "category", "eid", "lex_id", "xml_file", "mtriple", "question_idx", "question_type", "selected_role", "question", "question_es")


def match_entries(entries: DataFrame, qa: DataFrame) -> DataFrame:
    """``(base_id, question identity)`` of questions whose triple is, in any case, one of an entry's."""
    facts = entries.select("base_id", F.explode("mtriples").alias("m")).select("base_id", normalise_triple(F.col("m")).alias("key")).distinct()
    identity = [c for c in QA_IDENTITY if c in qa.columns]
    asked = qa.select(*[F.col(c).alias(f"qa_{c}") for c in identity], normalise_triple(F.col("mtriple")).alias("key"))
    return facts.join(asked, "key").drop("key").distinct()


def covered_triples(facts: DataFrame, qa: DataFrame) -> DataFrame:
    """``(triple, covered)``: the questions' triples, and whether some document has them."""
    asked = qa.select(normalize_ws(F.col("mtriple")).alias("triple")).where("triple <> ''").distinct()
    return asked.join(facts.select("triple").distinct().withColumn("there", F.lit(True)), "triple", "left").select("triple", F.coalesce("there", F.lit(False)).alias("covered"))


def keep_covered(qa: DataFrame, facts: DataFrame) -> DataFrame:
    """Questions whose triple some document has."""
    keys = facts.select(F.col("triple").alias("_t")).distinct()
    return qa.join(keys, normalize_ws(F.col("mtriple")) == F.col("_t"), "left_semi")


def counts_by(df: DataFrame, field: str, value: Column | str) -> DataFrame:
    """``(field, value, n)`` for a manifest."""
    return df.groupBy((F.col(value) if isinstance(value, str) else value).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(field).alias("field"), "value", "n")


def manifest(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The numbers of a collection: totals, and documents and queries by size, language and kind."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("field"), F.lit("total").alias("value"), "n")
    parts = [total(docs, "docs"), total(queries, "queries"), total(qrels, "qrels"), counts_by(docs, "docs_by_n_triples", "n_triples"), counts_by(queries, "queries_by_lang", "query_lang"), counts_by(queries, "queries_by_type", "question_type3")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
