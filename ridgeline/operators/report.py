"""Tables over summaries and resource profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.text import normalize_representation

#: The order in which tables show representations; fixed.
ORDER = ("triples", "text", "concat", "hybrid_rrf", "hybrid_score", "hybrid_union_candidates", "hybrid_cascade")
METRIC = "nDCG@10"


def select_level(summary: DataFrame, split: str = "ALL", question_type: str = "ALL", level: str = "overall") -> DataFrame:
    """Rows of a split and question type: rolled up over languages, or one row per direction."""
    rows = summary.where((F.col("split") == split) & (F.col("question_type") == question_type))
    langs, rolled = ("query_lang", "doc_lang", "scenario"), lambda c: F.col(c) == "ALL"
    if level == "overall":
        return rows.where(rolled(langs[0]) & rolled(langs[1]) & rolled(langs[2]))
    if level == "directional":
        return rows.where(~rolled("query_lang") & ~rolled("doc_lang") & (F.col("scenario") == F.concat_ws("_to_", "query_lang", "doc_lang")))
    raise ValueError(f"no such level: {level}")


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate over rows that have a value and a positive weight; null without any."""
    good = value.isNotNull() & ~F.isnan(value) & (weight > 0)
    return F.sum(F.when(good, value * weight)) / F.sum(F.when(good, weight))


def aggregate(summary: DataFrame, keys: list[str], metric: str = METRIC) -> DataFrame:
    return summary.groupBy(*keys).agg(F.sum("n_queries").alias("n_queries"), F.round(weighted_mean(F.col(f"`{metric}`").cast("double"), F.col("n_queries").cast("double")), 6).alias(metric))


def order_key(representation: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ORDER]), representation).cast("int")


def by_representation(summary: DataFrame, more: tuple[str, ...] = (), metric: str = METRIC) -> DataFrame:
    """Means per known representation (and other keys), with the order to show them in."""
    clean = summary.withColumn("representation_clean", normalize_representation(F.col("representation")))
    out = aggregate(clean, ["representation_clean", *more], metric).withColumn("position", order_key(F.col("representation_clean")))
    return out.where("position > 0")


def pivoted(summary: DataFrame, rows: list[str], column: str, values: list[str], metric: str = METRIC) -> DataFrame:
    """Weighted means in a grid; what isn't there is null."""
    m, w = F.col(f"`{metric}`").cast("double"), F.col("n_queries").cast("double")
    return summary.groupBy(*rows).agg(*[F.round(weighted_mean(F.when(F.col(column) == v, m), w), 6).alias(v) for v in values])


def directions(summary: DataFrame, metric: str = METRIC) -> DataFrame:
    """Means per method and direction."""
    return aggregate(summary.withColumn("direction", F.concat_ws("→", "query_lang", "doc_lang")), ["method", "direction"], metric)


def hybrid_gain(summary: DataFrame, metric: str = METRIC) -> DataFrame:
    """The mean gain of each fused representation over the better single one, over methods and directions."""
    clean = summary.withColumns({"representation_clean": normalize_representation(F.col("representation")), "direction": F.concat_ws("→", "query_lang", "doc_lang")})
    wide = pivoted(clean, ["method", "direction"], "representation_clean", list(ORDER), metric).withColumn("best_single", F.greatest("triples", "text"))
    long = wide.unpivot(["method", "direction", "best_single"], [c for c in ORDER if c not in ("triples", "text")], "hybrid", "value")
    return long.where("value is not null and best_single is not null").groupBy("hybrid").agg(F.round(F.avg(F.col("value") - F.col("best_single")), 6).alias("mean_gain"), F.count("*").alias("n"))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], metric: str = METRIC) -> DataFrame:
    """Both tables' values by key and how far they are apart."""
    a, b = left.select(*keys, F.col(f"`{metric}`").alias("value_left")), right.select(*keys, F.col(f"`{metric}`").alias("value_right"))
    return a.join(b, keys, "full").withColumn("abs_diff", F.abs(F.col("value_left") - F.col("value_right")))


def complexities(summaries: dict[str, DataFrame]) -> DataFrame:
    """Several summaries as one, tagged by complexity."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("complexity", F.lit(name)).withColumn("representation_clean", normalize_representation(F.col("representation"))) for name, s in summaries.items()])


#: Derived columns: name, seconds and count; fixed.
DERIVED = (
    ("doc_encode_ms_per_doc", "doc_encode_time_s", "n_docs"), ("index_ms_per_doc", "index_time_s", "n_docs"), ("query_encode_ms_per_query", "query_encode_time_s", "n_queries"), ("retrieval_ms_per_query", "retrieval_time_s", "n_queries"),
    ("scoring_ms_per_query", "scoring_time_s", "n_queries"), ("rerank_ms_per_candidate_pair", "rerank_time_s", "n_candidate_pairs"), ("fusion_ms_per_query", "fusion_time_s", "n_queries"),
)


def resource_detail(profiles: DataFrame) -> DataFrame:
    """Profiles with milliseconds per item for the stages they have; null for no items."""
    made = {name: F.round(F.col(s) / F.nullif(F.col(n), F.lit(0)) * 1000, 6) for name, s, n in DERIVED if {s, n} <= set(profiles.columns)}
    return profiles.withColumns(made) if made else profiles


def resource_compact(detail: DataFrame) -> DataFrame:
    """Runs, means and the median time per method and representation."""
    keys = [c for c in ("method", "representation") if c in detail.columns]
    means = [c for c in ("peak_cpu_rss_mb", "peak_gpu_allocated_mb", *[d[0] for d in DERIVED]) if c in detail.columns]
    return detail.groupBy(*keys).agg(
        F.count("profile_path").alias("runs"), F.round(F.avg("total_time_s"), 6).alias("mean_total_time_s"), F.round(F.median("total_time_s"), 6).alias("median_total_time_s"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in means]
    )


def score_stats(df: DataFrame, score: str = "score", *keys: str) -> DataFrame:
    c = F.col(score)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.round(F.min(c), 6).alias("least"), F.round(F.max(c), 6).alias("most"))
