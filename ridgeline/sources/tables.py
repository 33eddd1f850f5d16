"""Tables in files: readers and writers that choose the format by suffix."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.text import text_or_empty
from ridgeline.operators.topk import first_per_key

ALL = ("ALL", "*", "NONE", "NULL", "")
REPRESENTATIONS = ("triples", "text", "concat")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", schema: str | T.StructType | None = None) -> DataFrame:
    """Columns are strings unless a schema says otherwise; cells may hold line breaks and doubled quotes; empty ones are null."""
    reader = spark.read.options(header=True, sep=sep, multiLine=True, escape='"', quote='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """parquet, pq, csv or tsv by suffix; another suffix is tried as Parquet, then as CSV."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix in ("xlsx", "xlsm", "xls"):
        raise ValueError(f"Spark has no reader for spreadsheets: {path}")
    if suffix in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if suffix == "tsv" else ",", schema)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    try:
        return spark.read.parquet(path)
    except Exception:
        return read_csv(spark, path, schema=schema)


def table_path(spark: SparkSession, folder: str, stem: str) -> str:
    """The Parquet file of a name if there is one, else the CSV file."""
    for suffix in ("parquet", "csv"):
        if exists(spark, path := f"{folder.rstrip('/')}/{stem}.{suffix}"):
            return path
    raise FileNotFoundError(f"{folder} has neither {stem}.parquet nor {stem}.csv")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """csv or tsv by suffix, else Parquet."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("csv", "tsv"):
        df.write.mode(mode).options(header=True, sep="\t" if suffix == "tsv" else ",", escape='"').csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_fields(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """A fixed list of columns as CSV; missing ones are empty, others are left out."""
    write_table(df.select(*[F.col(f) if f in df.columns else F.lit("").alias(f) for f in fields]), path if path.endswith(".csv") else f"{path}.csv", mode)


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def expand_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files of some globs, sorted; an error if there are none."""
    found: set[str] = set()
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        found |= {str(m.getPath()) for m in (matches or [])}
    if not found:
        raise FileNotFoundError(f"nothing matches {patterns}")
    return sorted(found)


def representation_column(representation: str, lang: str) -> str:
    if representation not in REPRESENTATIONS:
        raise ValueError(f"no such representation: {representation}")
    return f"{representation}_{lang}"


def effective_doc_lang(representation: str, lang: str, mix_text_lang: str = "en") -> str:
    """Text has no mixed form: for ``mix`` it is the text of another language."""
    return mix_text_lang if representation == "text" and lang == "mix" else lang


def docs_for_run(docs: DataFrame, representation: str, lang: str) -> DataFrame:
    """``(docno, text, doc_lang)`` of one representation; documents without text drop out."""
    column = representation_column(representation, effective_doc_lang(representation, lang))
    require(docs, "docno", column)
    return docs.select("docno", text_or_empty(F.col(column)).alias("text"), F.lit(lang).alias("doc_lang")).where(F.trim("text") != "")


def queries_for_run(queries: DataFrame, lang: str, split: str | None = None) -> DataFrame:
    """Queries of a language, and of a split unless it is one of ALL."""
    out = require(queries, "qid", "query", "query_lang").where(F.col("query_lang") == lang)
    return out if split is None or split.upper() in ALL else out.where(F.col("split") == split)


def load_run(run: DataFrame, source: str, top_n: int | None = None) -> DataFrame:
    """A run with its ids as strings and a tag, cut to the best ``top_n`` of each query."""
    out = require(run, "qid", "docno", "score", "rank").withColumns({"qid": F.col("qid").cast("string"), "docno": F.col("docno").cast("string"), "source": F.lit(source)})
    return out if top_n is None else first_per_key(out, ["qid"], [F.col("rank"), F.col("docno")], top_n)


RUN_COLUMNS = ("qid", "docno", "score", "rank", "method", "representation", "query_lang", "doc_lang", "scenario", "query_id_base", "split", "category", "question_type3", "selected_role")


def run_frame(results: DataFrame, **constants: str) -> DataFrame:
    """The standard columns of a run, then the others; constants are attached, missing columns are null."""
    out = results.withColumns({k: F.lit(v) for k, v in constants.items()})
    if {"query_lang", "doc_lang"} <= set(out.columns) and "scenario" not in out.columns:
        out = out.withColumn("scenario", F.concat_ws("_to_", "query_lang", "doc_lang"))
    missing = {c: F.lit(None).cast("string") for c in RUN_COLUMNS if c not in out.columns}
    out = out.withColumns(missing) if missing else out
    return out.select(*RUN_COLUMNS, *[c for c in out.columns if c not in RUN_COLUMNS])


def save_run(results: DataFrame, path: str, **constants: str) -> None:
    write_table(run_frame(results, **constants), path)


#: Column names of older summaries and the present ones; fixed.
RENAMED = {"question_t": "question_type", "question_type3": "question_type", "question_type_3way": "question_type", "represent": "representation", "repr": "representation"}
TEXT_COLUMNS = ("method", "representation", "query_lang", "doc_lang", "scenario", "split", "question_type")


def read_summary(spark: SparkSession, path: str, methods: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """A summary in CSV, with commas and points or with semicolons and decimal commas.

    Cells are trimmed, numbers are cast (else null), old column names and, by ``methods``, method names are replaced.
    """
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    raw = read_csv(spark, path, ";" if line.count(";") > line.count(",") else ",")
    return clean_summary(raw, methods, strict)


def clean_summary(raw: DataFrame, methods: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    df = raw.toDF(*[RENAMED.get(c.strip(), c.strip()) for c in raw.columns])
    require(df, *TEXT_COLUMNS, "n_queries")
    out = df.select(*[F.trim(c).alias(c) if c in TEXT_COLUMNS else F.replace(F.trim(F.col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double").alias(c) for c in df.columns])
    if methods:
        if strict:
            there = {r[0] for r in out.select("method").where(F.col("method").isin(list(methods))).distinct().collect()}
            if missing := sorted(set(methods) - there):
                raise ValueError(f"no such methods: {missing}")
        out = out.replace(methods, subset=["method"])
    return out


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Run profiles, one JSON object per file, with their path."""
    return spark.read.option("multiLine", True).json(path).withColumn("profile_path", F.col("_metadata.file_path"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small dictionary as one JSON file in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    finally:
        stream.close()
