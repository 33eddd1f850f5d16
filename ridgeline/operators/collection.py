"""From corpus entries to documents: merging, eligibility, mixed languages, wide documents, checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.stable import mixed_pattern, stable_index
from ridgeline.functions.text import TRIPLE_SEP, concat_field, entry_id, normalize_ws, split_triples, text_field, text_id, triples_field, tripleset_id
from ridgeline.operators.topk import first_per_key
from ridgeline.sources.checkpoint import keep

KEY = ["split", "category", "eid", "size"]
LANGS = ("en", "es", "mix")


def join_unique(value: Column, order: Column) -> Column:
    """An aggregate: the distinct texts that aren't blank, in order, one per line. Null ones aren't gathered."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), normalize_ws(value).alias("v"))))), lambda x: x["v"])
    return F.array_join(F.array_distinct(F.filter(ordered, lambda v: v != "")), "\n")


def merge_entries(entries: DataFrame, order: Column) -> DataFrame:
    """One entry per key: the first triples, the first Spanish triples there are, and all distinct texts in order."""
    ranked = entries.withColumn("_o", order)
    texts = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", c))), lambda x: x[c]))).alias(c)
    return ranked.groupBy(*KEY).agg(
        F.min_by("xml_file", "_o").alias("xml_file"), F.array_sort(F.collect_set("xml_file")).alias("xml_files_seen"), F.min_by("mtriples", "_o").alias("mtriples"),
        F.coalesce(F.min_by(F.when(F.size("striples") > 0, F.col("striples")), F.when(F.size("striples") > 0, F.col("_o"))), F.array().cast("array<string>")).alias("striples"), texts("lex_en"), texts("lex_es"),
    ).withColumn("base_id", entry_id(*[F.col(c) for c in KEY]))


def merge_collisions(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows whose triples differ from those that were kept: ``(base_id, field, kept, seen, xml_file)``."""
    kept = merged.select(*KEY, "base_id", F.col("mtriples").alias("kept_m"), F.col("striples").alias("kept_s"))
    met = entries.join(kept, KEY)
    joined = lambda c: F.array_join(c, TRIPLE_SEP)
    one = met.where(F.col("mtriples") != F.col("kept_m")).select("base_id", F.lit("mtriples").alias("field"), joined("kept_m").alias("kept"), joined("mtriples").alias("seen"), "xml_file")
    two = met.where((F.size("striples") > 0) & (F.col("striples") != F.col("kept_s"))).select("base_id", F.lit("striples").alias("field"), joined("kept_s").alias("kept"), joined("striples").alias("seen"), "xml_file")
    return one.unionByName(two)


def ineligibility(min_triples: int = 2, aligned: bool = True, spanish_text: bool = True) -> Column:
    """The reasons why an entry can't be used, as an array; parameters give the variants of the mapping."""
    m, s = F.size("mtriples"), F.size("striples")
    reasons = [F.when(F.col("size") < min_triples, f"size_lt_{min_triples}"), F.when(m < min_triples, f"n_mtriples_lt_{min_triples}"), F.when(s == 0, "missing_es_striples")]
    if aligned:
        reasons.append(F.when((s > 0) & (m != s), "tripleset_triple_count_mismatch"))
    reasons.append(F.when(F.size("lex_en") == 0, "missing_en_lex"))
    if spanish_text:
        reasons.append(F.when(F.size("lex_es") == 0, "missing_es_lex"))
    return F.array_compact(F.array(*reasons))


def eligible(entries: DataFrame, **rules: object) -> tuple[DataFrame, DataFrame]:
    """Entries that can be used, and the others with their reasons."""
    judged = entries.withColumn("reasons", ineligibility(**rules))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ";"))


def mix_entries(entries: DataFrame, seed: int = 42, pattern: Column | None = None) -> DataFrame:
    """Adds ``mixed_pattern`` and ``mixed_triples``: each place's triple in the language of the pattern."""
    how = mixed_pattern("base_id", F.size("mtriples"), F.lit(seed)) if pattern is None else pattern
    out = entries.withColumn("mixed_pattern", how)
    return out.withColumn("mixed_triples", F.transform("mixed_pattern", lambda lang, i: F.when(lang == "en", F.get("mtriples", i)).otherwise(F.get("striples", i))))


def tripleset_docs(mixed: DataFrame) -> DataFrame:
    """One row per entry and language."""
    by_lang = {"en": "mtriples", "es": "striples", "mix": "mixed_triples"}
    rows = F.explode(F.array(*[F.struct(F.lit(lang).alias("lang"), F.col(c).alias("parts")) for lang, c in by_lang.items()]))
    out = mixed.withColumn("x", rows).select(*KEY, "base_id", "xml_file", "x.lang", "x.parts", "mtriples", "mixed_pattern")
    is_mix = F.col("lang") == "mix"
    count = lambda lang: F.when(is_mix, F.size(F.filter("mixed_pattern", lambda p: p == lang)))
    return out.select(
        tripleset_id(F.col("base_id"), F.col("lang")).alias("doc_id"), "base_id", *KEY, "xml_file", "lang", F.size("parts").alias("n_triples"), F.array_join("parts", TRIPLE_SEP).alias("triples"), F.array_join("mtriples", TRIPLE_SEP).alias("supporting_mtriples"),
        F.when(is_mix, F.array_join("mixed_pattern", ",")).alias("mixed_lang_pattern"), count("en").alias("mixed_n_en"), count("es").alias("mixed_n_es"),
    )


def text_docs(entries: DataFrame, seed: int = 42) -> DataFrame:
    """One chosen lexicalisation per entry and language; the mixed text is the English one."""
    chosen = lambda lang: stable_index(F.concat(F.lit(f"{lang}::"), F.col("base_id")), F.size(f"lex_{lang}"), seed)
    rows = F.explode(F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(source).alias("source"), chosen(source).alias("i"), F.get(f"lex_{source}", chosen(source)).alias("text")) for lang, source in (("en", "en"), ("es", "es"), ("mix", "en"))]))
    out = entries.withColumn("x", rows)
    return out.select(text_id(F.col("base_id"), F.col("x.lang")).alias("doc_id"), "base_id", *KEY, "xml_file", "x.lang", F.col("x.i").alias("lex_idx"), "x.text", F.array_join("mtriples", TRIPLE_SEP).alias("supporting_mtriples"), F.col("x.source").alias("text_source_lang"), F.lit("stable_hash").alias("text_selection_method"))


def closest_lexicalisation(lexes: DataFrame, keys: list[str], similarity: str = "similarity", index: str = "lex_idx") -> DataFrame:
    """The lexicalisation of greatest similarity per key; the earliest on a tie."""
    return first_per_key(lexes, keys, [F.col(similarity).desc(), F.col(index)])


def closest_by_encoder(lexes: DataFrame, keys: list[str], triples: str, lex: str, encode: Callable[[DataFrame, str, str], DataFrame], index: str = "lex_idx") -> DataFrame:
    """The lexicalisation whose vector is nearest to that of the entry's triples, with its ``similarity``, rounded to 5 places.

    ``encode`` adds a vector of a text column under a name; a vector of zeros is like nothing (0).
    """
    both = encode(encode(lexes, triples, "_t"), lex, "_x")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot("_t", "_t") * dot("_x", "_x"))
    scored = both.withColumn("similarity", F.round(F.when(size > 0, dot("_t", "_x") / size).otherwise(0.0), 5)).drop("_t", "_x")
    return closest_lexicalisation(scored, keys, "similarity", index)


def wide_docs(triples: DataFrame, texts: DataFrame, langs: tuple[str, ...] = LANGS, triples_variant: str = "normalized", text_variant: str = "normalized", parallel: bool = True, min_triples: int = 1) -> DataFrame:
    """One row per base id with each representation in each language.

    ``parallel`` keeps documents that have triples and a text in every language; ``min_triples`` drops smaller ones.
    """
    t = triples.groupBy("base_id").agg(
        *[F.min(c).alias(c) for c in ("split", "category", "eid", "size")], F.max("n_triples").alias("n_triples"),
        *[x for lang in langs for x in (join_unique(F.when(F.col("lang") == lang, F.col("triples")), F.col("doc_id")).alias(f"triples_{lang}_raw"), join_unique(F.when(F.col("lang") == lang, F.col("supporting_mtriples")), F.col("doc_id")).alias(f"supporting_mtriples_{lang}"))],
    )
    x = texts.groupBy("base_id").agg(
        *[y for lang in langs for y in (join_unique(F.when(F.col("lang") == lang, F.col("text")), F.struct("lex_idx", "doc_id")).alias(f"text_{lang}_raw"), F.size(F.collect_set(F.when(F.col("lang") == lang, F.col("lex_idx")))).cast("long").alias(f"n_lex_{lang}"))],  # distinct counts would repeat every row
    )
    met = t.join(x, "base_id", "left").fillna("", [f"text_{lang}_raw" for lang in langs])
    if parallel:
        met = met.where(reduce(lambda a, b: a & b, [(F.col(f"{kind}_{lang}_raw") != "") for lang in langs for kind in ("triples", "text")]))
    met = met.where(F.col("n_triples") >= min_triples)
    for lang in langs:
        met = met.withColumn(f"triples_{lang}", triples_field(F.col(f"triples_{lang}_raw"), triples_variant)).withColumn(f"text_{lang}", text_field(F.col(f"text_{lang}_raw"), text_variant))
        met = met.withColumn(f"concat_{lang}", concat_field(F.col(f"triples_{lang}"), F.col(f"text_{lang}")))
    return met.withColumnRenamed("base_id", "docno")


def inventory_faults(triples: DataFrame, texts: DataFrame, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """``(fault, n)`` of what should be empty: ids of one side only by language, sizes, and mixed texts that aren't the English ones.

    What is compared of each side is kept, so a side is made once.
    """
    triples, texts = keep(triples.select("base_id", "lang", "size")), keep(texts.select("base_id", "lang", "size", "text"))
    ids = lambda df: df.select("base_id", "lang").distinct()
    one_side = ids(triples).withColumn("side", F.lit("tripleset_only")).join(ids(texts), ["base_id", "lang"], "left_anti")
    other = ids(texts).withColumn("side", F.lit("text_only")).join(ids(triples), ["base_id", "lang"], "left_anti")
    not_everywhere = ids(triples.unionByName(texts, allowMissingColumns=True)).where(F.col("lang").isin(*langs)).groupBy("base_id").agg(F.count("*").alias("k")).where(F.col("k") < len(langs))
    sizes = lambda df, name: df.groupBy("lang", "size").agg(F.count("*").alias(name))
    uneven = sizes(triples, "a").join(sizes(texts, "b"), ["lang", "size"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    english, mixed = (texts.where(F.col("lang") == lang).select("base_id", F.col("text").alias(f"text_{lang}")) for lang in ("en", "mix"))
    differs = english.join(mixed, "base_id").where("text_en <> text_mix")
    counts = [(name, df) for name, df in (("tripleset_only", one_side), ("text_only", other), ("not_in_every_language", not_everywhere), ("size_distribution", uneven), ("text_mix_differs", differs))]
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n") for name, df in counts])


def mapping_report(triples: DataFrame, texts: DataFrame, questions: DataFrame) -> DataFrame:
    """``(counter, value, n)``: documents by language and size, mixed patterns, repeated ids, and triples of questions that documents cover.

    Counters of documents are rows of one pass over each side, so they are summed before the shuffle.
    """

    def counted(df: DataFrame, **values: Column) -> DataFrame:
        named = F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), v.cast("string").alias("value")) for name, v in values.items()])).alias("x")
        return df.select(named).select("x.*").where("value is not null").groupBy("counter", "value").agg(F.count("*").alias("n"))

    sized = F.concat_ws(",", "lang", "size")
    mixed = F.when(F.col("lang") == "mix", F.concat_ws(",", "size", "mixed_n_en", "mixed_n_es"))
    documents = counted(triples, tripleset_lang=F.col("lang"), tripleset_size=sized, mixed_pattern=F.col("mixed_lang_pattern"), mixed_counts=mixed)
    written = counted(texts, text_lang=F.col("lang"), text_size=sized, text_source_lang=F.col("text_source_lang"))
    repeats = [repeated_ids(df).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("repeated_ids").alias("counter"), F.lit(name).alias("value"), "n") for name, df in (("triplesets", triples), ("texts", texts))]
    asked = questions.select(normalize_ws(F.col("mtriple")).alias("t")).where("t <> ''").distinct()
    held = lambda df, flag: df.select(F.explode(split_triples(F.col("supporting_mtriples"))).alias("t")).distinct().withColumn(flag, F.lit(True))
    met = asked.join(held(triples, "a"), "t", "left").join(held(texts, "b"), "t", "left").select(F.col("a").isNotNull().alias("a"), F.col("b").isNotNull().alias("b"))
    kinds = {"asked": F.lit(True), "by_triplesets": F.col("a"), "by_texts": F.col("b"), "by_both": F.col("a") & F.col("b"), "by_neither": ~F.col("a") & ~F.col("b")}
    sums = met.agg(*[F.count_if(when).alias(name) for name, when in kinds.items()])
    covered = sums.select(F.lit("covered").alias("counter"), F.explode(F.create_map(*[x for name in kinds for x in (F.lit(name), F.col(name))])).alias("value", "n"))
    return reduce(DataFrame.unionByName, [documents, written, *repeats, covered])


def repeated_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def size_distribution(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count("*").alias("n"))


def size_comparison(left: DataFrame, right: DataFrame, key: str = "size") -> DataFrame:
    """Counts of two sides by size, 0 where one has none, and their difference."""
    a, b = size_distribution(left, key).withColumnRenamed("n", "n_left"), size_distribution(right, key).withColumnRenamed("n", "n_right")
    out = a.join(b, key, "full").fillna(0, ["n_left", "n_right"])
    return out.withColumn("difference", F.col("n_left") - F.col("n_right"))
