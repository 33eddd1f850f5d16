"""A collection of facts about customers, made from the relational tables; for queries and tests.

Each customer is an entry whose facts are its nation, that nation's region, its market segment and its first orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.text import entry_id

PREDICATES = {"nation": "nación", "region": "región", "segment": "segmento", "order": "pedido"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    split = F.when(key % 10 == 8, "dev").when(key % 10 == 9, "test").otherwise("train")
    out = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = out.select("c_custkey", "c_name", F.col("c_mktsegment").alias("category"), "n_name", "r_name", F.concat(F.lit("Id"), key.cast("string")).alias("eid"), (1 + key % 7).cast("int").alias("size"), split.alias("split"))
    return out.withColumn("base_id", entry_id(*[F.col(x) for x in ("split", "category", "eid", "size")]))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(base_id, c_custkey, pos, s, p, o)``, at most ``size`` per entry."""
    c = customers(spark, sf_dir)
    fixed = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for i, s, p, o in ((1, F.col("c_name"), "nation", F.col("n_name")), (2, F.col("n_name"), "region", F.col("r_name")), (3, F.col("c_name"), "segment", F.col("category")))]))
    own = c.withColumn("f", fixed).select("base_id", "c_custkey", "size", "f.pos", "f.s", "f.p", "f.o")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k")).where("k <= 4")
    bought = c.join(o, c.c_custkey == o.o_custkey).select("base_id", "c_custkey", "size", (F.col("k") + 3).alias("pos"), F.col("c_name").alias("s"), F.lit("order").alias("p"), F.col("o_orderkey").cast("string").alias("o"))
    return own.unionByName(bought).where("pos <= size").drop("size")


def triple(p: object = "p") -> F.Column:
    return F.concat_ws(" | ", "s", p, "o")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as a corpus scan gives them. Some lack the Spanish text, and some have a Spanish triple too few."""
    spanish = F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair])[F.col("p")]
    f = facts(spark, sf_dir).select("base_id", F.struct("pos", triple().alias("m"), triple(spanish).alias("s")).alias("t")).groupBy("base_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    c = customers(spark, sf_dir).join(f, "base_id")
    m, s = F.transform("t", lambda x: x["m"]), F.transform("t", lambda x: x["s"])
    en = [F.concat_ws(" ", "c_name", F.lit("of"), "n_name", F.lit("buys"), "category"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("In "), F.col("n_name"), F.lit(", "), F.col("c_name"), F.lit(" trades.")))]
    es = F.when(F.col("c_custkey") % 17 != 0, F.concat_ws(" ", "c_name", F.lit("de"), "n_name", F.lit("compra"), "category"))
    return c.select(
        "base_id", "split", "category", "eid", "size", "c_custkey", F.concat(F.col("category"), F.lit(".xml")).alias("xml_file"), m.alias("mtriples"),
        F.when(F.col("c_custkey") % 13 == 0, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s).alias("striples"), F.array_compact(F.array(*en)).alias("lex_en"), F.array_compact(F.array(es)).alias("lex_es"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the eligible entries with two or more triples, in English, Spanish and mixed."""
    from ridgeline.functions.stable import mixed_pattern_by_hash
    from ridgeline.operators.collection import eligible, mix_entries, text_docs, tripleset_docs, wide_docs

    kept, _ = eligible(entries(spark, sf_dir))
    mixed = mix_entries(kept, pattern=mixed_pattern_by_hash(F.col("base_id"), F.size("mtriples")))
    return wide_docs(tripleset_docs(mixed), text_docs(kept))


#: Questions ask for a nation's region; three languages, four roles.
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa``: a row per nation and role, with one question column per language; one state in five is invalid."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    met = n.join(r, n.n_regionkey == r.r_regionkey)
    roles = F.posexplode(F.array(*[F.lit(x) for x in ("yes_q", "no_q", "extractive_1", "extractive_2")]))
    out = met.select("n_nationkey", "n_name", "r_name", roles.alias("question_idx", "selected_role"))
    row = F.col("n_nationkey") * 4 + F.col("question_idx")
    asked = lambda a, b: F.concat(F.lit(a), F.col("n_name"), F.lit(b))
    return out.select(
        row.cast("long").alias("qa_row_id"), F.when(row % 10 < 8, "train").otherwise("test").alias("split"), F.lit("Nation").alias("category"), F.concat(F.lit("Id"), F.col("n_nationkey").cast("string")).alias("eid"), F.lit("0").alias("lex_id"),
        "question_idx", "selected_role", F.when(F.col("question_idx") < 2, "yes_no").otherwise("extractive").alias("question_type"), F.concat_ws(" | ", "n_name", F.lit("region"), "r_name").alias("mtriple"),
        asked("Which region holds ", "?").alias("question"), asked("¿Qué región tiene ", "?").alias("question_es"), F.when(row % 7 != 0, asked("Quina region te ", "?")).alias("question_ca"), F.col("r_name").alias("answer"),
        F.when(row % 5 == 0, "invalid_after_retries").otherwise("valid").alias("validation_status"), F.lit("nation.xml").alias("xml_file"),
    )


def order_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order, grouped by customer and number of text; answers, corrections and flags by rule."""
    k = F.col("o_orderkey")
    yes_no = k % 2 == 0
    answer = F.when(yes_no, F.when(k % 4 == 0, "Yes").otherwise("no")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.lit("train").alias("split"), F.concat(F.lit("cat"), (F.col("o_custkey") % 10).cast("string")).alias("category"), F.concat(F.lit("Id"), F.col("o_custkey").cast("string")).alias("eid"), (k % 3).cast("string").alias("lex_id"),
        (k % 4).cast("int").alias("question_idx"), F.when(yes_no, "yes_no").otherwise("extractive").alias("question_type"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("What about "), F.col("o_orderpriority"), F.lit(" "), (k % 50).cast("string"), F.lit("?"))).alias("question"), answer.alias("answer"),
        F.when(k % 6 == 0, "yes").when(k % 9 == 0, " ").alias("corrected_answer"), F.when(k % 6 == 0, "CORRECTED").otherwise("").alias("correction_flag"), F.col("o_orderkey"),
    )


FIXTURE_SQL = r"""
base AS (
  SELECT c_custkey, c_name, c_mktsegment AS category, n_name, r_name, concat('Id', c_custkey) AS eid, cast(1 + c_custkey % 7 AS int) AS size,
    CASE WHEN c_custkey % 10 = 8 THEN 'dev' WHEN c_custkey % 10 = 9 THEN 'test' ELSE 'train' END AS split
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
customers AS (SELECT *, concat(split, '__', category, '__', eid, '__', size, 'triples') AS base_id FROM base),
facts AS (
  SELECT base_id, c_custkey, pos, s, p, o FROM (
    SELECT base_id, c_custkey, size, 1 AS pos, c_name AS s, 'nation' AS p, n_name AS o FROM customers
    UNION ALL SELECT base_id, c_custkey, size, 2, n_name, 'region', r_name FROM customers
    UNION ALL SELECT base_id, c_custkey, size, 3, c_name, 'segment', category FROM customers
    UNION ALL SELECT base_id, c_custkey, size, 3 + k, c_name, 'order', cast(o_orderkey AS varchar)
      FROM customers JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) ON c_custkey = o_custkey WHERE k <= 4
  ) WHERE pos <= size
),
spelled AS (
  SELECT base_id, list(concat(s, ' | ', p, ' | ', o) ORDER BY pos) AS mtriples,
    list(concat(s, ' | ', CASE p WHEN 'nation' THEN 'nación' WHEN 'region' THEN 'región' WHEN 'segment' THEN 'segmento' ELSE 'pedido' END, ' | ', o) ORDER BY pos) AS st
  FROM facts GROUP BY base_id
),
entries AS (
  SELECT base_id, split, category, eid, size, c_custkey, concat(category, '.xml') AS xml_file, mtriples, CASE WHEN c_custkey % 13 = 0 THEN st[1 : len(st) - 1] ELSE st END AS striples,
    list_filter([concat(c_name, ' of ', n_name, ' buys ', category), CASE WHEN c_custkey % 3 = 0 THEN concat('In ', n_name, ', ', c_name, ' trades.') END], lambda x: x IS NOT NULL) AS lex_en,
    list_filter([CASE WHEN c_custkey % 17 <> 0 THEN concat(c_name, ' de ', n_name, ' compra ', category) END], lambda x: x IS NOT NULL) AS lex_es
  FROM customers JOIN spelled USING (base_id)
),
kept AS (
  SELECT * FROM entries WHERE size >= 2 AND len(mtriples) >= 2 AND len(striples) > 0 AND len(mtriples) = len(striples) AND len(lex_en) > 0 AND len(lex_es) > 0
),
hashed AS (
  SELECT base_id, mtriples, striples, lex_en, lex_es, split, category, eid, size, len(mtriples) AS n,
    list_transform(list_sort(list_transform(range(1, len(mtriples) + 1), lambda i: {'h': md5(concat('42::', base_id, '::', i)), 'i': i})), lambda x: x.i) AS places,
    CASE WHEN len(mtriples) % 2 = 1 AND right(md5(concat('42::', base_id)), 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE 0 END AS extra
  FROM kept
),
mixed AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(places[1 : n // 2 + extra], i) THEN 'en' ELSE 'es' END) AS pattern FROM hashed
),
chosen AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN pattern[i] = 'en' THEN mtriples[i] ELSE striples[i] END) AS xtriples,
    list_reduce(list_transform(range(1, 33), lambda i: cast(instr('0123456789abcdef', substr(md5(concat('42::en::', base_id)), i, 1)) - 1 AS bigint)), lambda a, d: (a * 16 + d) % len(lex_en)) AS i_en,
    list_reduce(list_transform(range(1, 33), lambda i: cast(instr('0123456789abcdef', substr(md5(concat('42::es::', base_id)), i, 1)) - 1 AS bigint)), lambda a, d: (a * 16 + d) % len(lex_es)) AS i_es
  FROM mixed
),
sides AS (
  SELECT base_id, split, category, eid, size, n, lang, array_to_string(CASE lang WHEN 'en' THEN mtriples WHEN 'es' THEN striples ELSE xtriples END, ' ||| ') AS triples_raw,
    array_to_string(mtriples, ' ||| ') AS supporting, CASE lang WHEN 'es' THEN lex_es[i_es % len(lex_es) + 1] ELSE lex_en[i_en % len(lex_en) + 1] END AS text_raw
  FROM chosen, (SELECT unnest(['en', 'es', 'mix']) AS lang)
),
written AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(triples_raw, '|||', ' . '), '|', ' '), '_', ' '), '([a-záéíóúüñ])([A-ZÁÉÍÓÚÜÑ])', '\1 \2', 'g'), '([A-ZÁÉÍÓÚÜÑ]+)([A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ])', '\1 \2', 'g'), '[^\p{L}\p{N}_\s.,;:()\-/]', ' ', 'g'), '\s+', ' ', 'g')) AS triples,
    trim(regexp_replace(regexp_replace(lower(replace(text_raw, '_', ' ')), '[^\p{L}\p{N}_\s.,;:()\-/]', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM sides
),
docs AS (SELECT *, base_id AS docno, concat('[TRIPLES] ', triples, ' [TEXT] ', text) AS concat_text FROM written),
qa AS (
  SELECT cast(n_nationkey * 4 + i AS bigint) AS qa_row_id, CASE WHEN (n_nationkey * 4 + i) % 10 < 8 THEN 'train' ELSE 'test' END AS split, 'Nation' AS category, concat('Id', n_nationkey) AS eid, '0' AS lex_id,
    cast(i AS int) AS question_idx, ['yes_q', 'no_q', 'extractive_1', 'extractive_2'][i + 1] AS selected_role, CASE WHEN i < 2 THEN 'yes_no' ELSE 'extractive' END AS question_type,
    concat(n_name, ' | region | ', r_name) AS mtriple, concat('Which region holds ', n_name, '?') AS question, concat('¿Qué región tiene ', n_name, '?') AS question_es,
    CASE WHEN (n_nationkey * 4 + i) % 7 <> 0 THEN concat('Quina region te ', n_name, '?') END AS question_ca, r_name AS answer,
    CASE WHEN (n_nationkey * 4 + i) % 5 = 0 THEN 'invalid_after_retries' ELSE 'valid' END AS validation_status, 'nation.xml' AS xml_file
  FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(range(4)) AS i)
),
oq AS (
  SELECT 'train' AS split, concat('cat', o_custkey % 10) AS category, concat('Id', o_custkey) AS eid, cast(o_orderkey % 3 AS varchar) AS lex_id, cast(o_orderkey % 4 AS int) AS question_idx,
    CASE WHEN o_orderkey % 2 = 0 THEN 'yes_no' ELSE 'extractive' END AS question_type, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('What about ', o_orderpriority, ' ', o_orderkey % 50, '?') END AS question,
    CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Yes' ELSE 'no' END ELSE o_orderstatus END AS answer,
    CASE WHEN o_orderkey % 6 = 0 THEN 'yes' WHEN o_orderkey % 9 = 0 THEN ' ' END AS corrected_answer, CASE WHEN o_orderkey % 6 = 0 THEN 'CORRECTED' ELSE '' END AS correction_flag, o_orderkey
  FROM orders
),
oqe AS (SELECT *, lower(CASE WHEN trim(coalesce(corrected_answer, '')) <> '' THEN trim(corrected_answer) ELSE trim(answer) END) AS eff FROM oq)
"""
