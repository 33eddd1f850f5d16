"""Corpora of entries in XML: one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTS = {"modifiedtripleset": "mtriple", "spanishtripleset": "striple", "enbttripleset": "bttriple", "catalantripleset": "ctriple"}
ENTRY_SCHEMA = (
    "_category string, _eid string, _size string, _shape string, _shape_type string, originaltripleset array<struct<otriple:array<string>>>, "
    + ", ".join(f"{block} array<struct<{item}:array<string>>>" for block, item in _LISTS.items())
    + ", lex array<struct<_VALUE:string,_lang:string,_lid:string>>, mtriple array<string>, striple array<string>, _broken string"
)


def _items(block: Column, item: str, loose: Column | None = None) -> Column:
    """Trimmed, not blank; from the block, or failing that from anywhere in the entry."""
    inner = F.flatten(F.transform(F.coalesce(block, F.array()), lambda b: F.coalesce(b[item], F.array().cast("array<string>"))))
    found = _present(inner)
    return found if loose is None else F.when(F.size(found) > 0, found).otherwise(_present(F.coalesce(loose, F.array().cast("array<string>"))))


def _present(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")  # bare F.trim would take the place as what to trim


def _lex(*langs: str, unmarked: bool = False) -> Column:
    lex = F.coalesce(F.col("lex"), F.array().cast("array<struct<_VALUE:string,_lang:string,_lid:string>>"))
    mine = F.filter(lex, lambda x: x["_lang"].isin(*langs) | (x["_lang"].isNull() if unmarked else F.lit(False)))
    return _present(F.transform(mine, lambda x: F.coalesce(x["_VALUE"], F.lit(""))))


def scan_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries with their triples and lexicalisations by language.

    Texts without a language are English. Entries without triples drop out, and so does every entry of a file that has a
    broken one. ``split``, ``size_dir`` and ``xml_file`` come from the path; ``position`` is the order in a file.
    """
    raw = spark.read.format("xml").schema(ENTRY_SCHEMA).options(rowTag="entry", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").load(paths)
    path = F.col("_metadata.file_path")
    rows = raw.select(
        path.alias("path"), F.regexp_extract(path, r"([^/]+)$", 1).alias("xml_file"), F.regexp_extract(path, r"/(train|dev|test)(?:/|$)", 1).alias("split"),
        F.regexp_extract(path, r"/(\d+)triples/", 1).try_cast("int").alias("size_dir"), F.monotonically_increasing_id().alias("position"),
        F.col("_category").alias("category"), F.col("_eid").alias("eid"), F.col("_size").try_cast("int").alias("size"), F.col("_shape").alias("shape"), F.col("_shape_type").alias("shape_type"),
        _items(F.col("originaltripleset"), "otriple").alias("otriples"), _items(F.col("modifiedtripleset"), "mtriple", F.col("mtriple")).alias("mtriples"),
        _items(F.col("spanishtripleset"), "striple", F.col("striple")).alias("striples"), _items(F.col("catalantripleset"), "ctriple").alias("ctriples"), _items(F.col("enbttripleset"), "bttriple").alias("bttriples"),
        _lex("en", unmarked=True).alias("lex_en"), _lex("es").alias("lex_es"), _lex("ca").alias("lex_ca"), _lex("en_bt").alias("lex_en_bt"), F.col("_broken").alias("broken"),
    )
    # The reader needs some other column beside that of broken records.
    judged = rows.groupBy("path").agg(F.max(F.col("broken").isNotNull()).alias("bad"), F.count("eid").alias("n"))
    bad = judged.where("bad and n >= 0").select("path")
    return rows.join(bad, "path", "left_anti").where(F.size("mtriples") > 0).withColumn("size", F.coalesce("size", F.size("mtriples"))).drop("broken", "path")


def layout_paths(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "dev", "test"), sizes: range = range(1, 8)) -> list[str]:
    """The folders of a corpus that are there: ``split/Ntriples`` for train and dev, everything below test."""
    from ridgeline.sources.tables import exists

    wanted = [f"{root.rstrip('/')}/{split}/{n}triples" for split in splits if split != "test" for n in sizes]
    wanted += [f"{root.rstrip('/')}/test"] if "test" in splits else []
    return [f"{p}/*.xml" if not p.endswith("/test") else p for p in wanted if exists(spark, p)]


def single_triple_entries(entries: DataFrame) -> DataFrame:
    """One row per lexicalisation of the entries of size 1."""
    return entries.where(F.col("size") == 1).select("split", "category", "eid", "xml_file", F.col("mtriples")[0].alias("mtriple"), F.get("otriples", F.lit(0)).alias("otriple"), F.posexplode("lex_en").alias("lex_id", "lex_text"))


def lex_index(entries: DataFrame, lang: str = "es") -> DataFrame:
    """``(split, category, eid, lex)``; of entries with the same key the last one counts."""
    return entries.groupBy("split", "category", "eid").agg(F.max_by(f"lex_{lang}", F.struct("xml_file", "position")).alias("lex"))
