"""Queries that write tables, corpora, runs and profiles, read them back and give what was read; registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.text import whole_number
from ridgeline.operators import collection
from ridgeline.operators.encoders import HashingEncoder, embed
from ridgeline.operators.topk import rank_per_key
from ridgeline.plans import fixture
from ridgeline.plans.fixture import table
from ridgeline.plans.queries import query
from ridgeline.sources import tables, xml
from ridgeline.sources.checkpoint import keep, scratch
from ridgeline.streaming.resume import Profile, run_resumable

# --- tables


@query("""SELECT kind, c_custkey::varchar AS c_custkey, concat(c_name, ', "', c_mktsegment, '"', chr(10), 'ñ; ', c_custkey) AS note, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN CASE kind WHEN 'parquet' THEN '' END ELSE c_name END AS maybe
FROM customer, (SELECT unnest(['parquet', 'csv', 'tsv']) AS kind)""")
def table_round_trip(spark, d):
    """Empty cells of text files are null, whether they were empty or null before."""
    key = F.col("c_custkey")
    note = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nñ; '), key.cast("string"))
    rows = table(spark, d, "customer").select(key.cast("string").alias("c_custkey"), note.alias("note"), F.when(key % 3 == 1, "").when(key % 3 == 2, F.col("c_name")).alias("maybe"))
    at, out = scratch(spark), None
    for kind in ("parquet", "csv", "tsv"):
        tables.write_table(rows, f"{at}/customer.{kind}")
        read = tables.read_table(spark, f"{at}/customer.{kind}").withColumn("kind", F.lit(kind))
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT 'region.parquet' AS file, r_regionkey::varchar AS id, r_name AS name FROM region UNION ALL SELECT 'nation.csv', n_nationkey::varchar, n_name FROM nation")
def table_path_choice(spark, d):
    at = scratch(spark)
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    for df, file in ((region, "region.parquet"), (region.limit(0), "region.csv"), (nation, "nation.csv")):
        tables.write_table(df, f"{at}/{file}")
    found = [tables.table_path(spark, at, stem) for stem in ("region", "nation")]
    one, two = (tables.read_table(spark, path).select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), "id", "name") for path in found)
    return one.unionByName(two)


@query("SELECT n_name, '' AS note, n_nationkey::varchar AS n_nationkey FROM nation")
def fields_csv(spark, d):
    """A fixed list of fields: ``note`` isn't in the table, ``n_regionkey`` isn't in the list."""
    at = f"{scratch(spark)}/fields"
    tables.write_fields(table(spark, d, "nation"), at, ["n_name", "note", "n_nationkey"])
    return tables.read_table(spark, f"{at}.csv").fillna("", ["note"])


@query("SELECT qa_row_id::varchar AS qa_row_id, mtriple, question, question_es, question_ca, answer FROM qa", fixed=True)
def question_csv(spark, d):
    at = f"{scratch(spark)}/qa.csv"
    tables.write_table(fixture.questions(spark, d), at)
    read = tables.require(tables.read_table(spark, at), "split", "category", "eid", "mtriple", "question", "answer")
    return read.select("qa_row_id", "mtriple", "question", "question_es", "question_ca", "answer")


_RANKED = "SELECT o_custkey::varchar AS qid, o_orderkey::varchar AS docno, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"


@query(f"SELECT qid, docno, round(score, 6) AS score, rank, source FROM ({_RANKED}), (SELECT unnest(['one', 'two']) AS source) WHERE rank <= CASE source WHEN 'one' THEN 2 ELSE 1 END")
def run_files(spark, d):
    """Two runs, saved, found by a glob and read with different depths."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("docno"), F.col("o_totalprice").alias("score"))
    run = rank_per_key(o, ["qid"], [F.col("score").desc(), F.col("docno")])
    at = scratch(spark)
    for name in ("one", "two"):
        tables.save_run(run, f"{at}/run_{name}.parquet", method=name)
    depth, out = {"one": 2, "two": 1}, None
    for path in tables.expand_paths(spark, [f"{at}/run_*.parquet", f"{at}/run_one*"]):
        name = path.rsplit("run_", 1)[-1].removesuffix(".parquet")
        read = tables.load_run(tables.read_table(spark, path), name, depth[name])
        out = read if out is None else out.unionByName(read)
    return out.select("qid", "docno", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "source")


@query("SELECT 'documents' AS name, count(*) AS n_docs, true AS timed FROM documents UNION ALL SELECT 'benchmark', count(*), true FROM benchmark UNION ALL SELECT 'labels', count(*), true FROM labels")
def profile_files(spark, d):
    at = scratch(spark)
    for name in ("documents", "benchmark", "labels"):
        profile = Profile(name=name)
        with profile.stage("index"):
            n = table(spark, d, name).count()
        tables.write_json(spark, profile.finish(n_docs=n), f"{at}/{name}.json")
    read = tables.read_profiles(spark, f"{at}/*.json")
    return read.select("name", "n_docs", ((F.col("total_time_s") >= F.col("index_time_s")) & F.col("profile_path").contains(F.col("name"))).alias("timed"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS call FROM orders")
def resumed_batches(spark, d):
    """The first call works on a third of the tasks, the second on all: what is done isn't done again."""
    at = f"{scratch(spark)}/done"
    tasks = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    for call, part in ((1, tasks.where("o_orderkey % 3 = 0")), (2, tasks), (3, tasks)):
        run_resumable(part, ["o_orderkey"], at, lambda df, call=call: df.withColumn("call", F.lit(call)), batches=2)
    return spark.read.parquet(at)


# --- corpora


def _corpus(spark: SparkSession, d: str) -> str:
    """The fixture's entries as XML files in folders by split and size, and a file that has a broken entry."""
    at = scratch(spark)
    lex = lambda column, lang: F.transform(column, lambda t, i: F.struct(t.alias("_VALUE"), lang.alias("_lang"), F.concat(F.lit("Id"), i.cast("string")).alias("_lid")))
    spoken = F.concat(lex("lex_en", F.lit(None).cast("string")), lex("lex_es", F.lit("es")))
    entry = [F.col("category").alias("_category"), F.col("eid").alias("_eid"), F.col("size").alias("_size"), F.struct(F.col("mtriples").alias("mtriple")).alias("modifiedtripleset"), F.struct(F.col("striples").alias("striple")).alias("spanishtripleset"), spoken.alias("lex")]
    rows = keep(fixture.entries(spark, d))

    def write(part: DataFrame, path: str) -> None:
        part.select(*entry).write.format("xml").options(rootTag="entries", rowTag="entry").save(f"{at}/{path}")

    for split in ("train", "dev"):
        for n in range(1, 8):
            write(rows.where((F.col("split") == split) & (F.col("size") == n)), f"{split}/{n}triples/all.xml")
    write(rows.where("split = 'test'"), "test")
    good = '<entry category="x" eid="Id0" size="1"><modifiedtripleset><mtriple>a | b | c</mtriple></modifiedtripleset><lex>a</lex></entry>'
    broken = f'<entries>{good}<entry category="x" eid="Id1" size="1"><lex>never closed</entry></entries>'
    spark.createDataFrame([(broken,)], "value string").coalesce(1).write.text(f"{at}/train/1triples/broken.xml")
    return at


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return keep(xml.scan_entries(spark, xml.layout_paths(spark, _corpus(spark, d))))


@query("""SELECT split, category, eid, size, array_to_string(mtriples, '~') AS mtriples, array_to_string(striples, '~') AS striples, array_to_string(lex_en, '~') AS lex_en, array_to_string(lex_es, '~') AS lex_es,
CASE WHEN split <> 'test' THEN size END AS size_dir FROM entries""", fixed=True)
def corpus_scan(spark, d):
    lists = [F.array_join(c, "~").alias(c) for c in ("mtriples", "striples", "lex_en", "lex_es")]
    return _scanned(spark, d).select("split", "category", "eid", "size", *lists, "size_dir")


@query("SELECT split, category, eid, mtriples[1] AS mtriple, cast(i - 1 AS int) AS lex_id, lex_en[i] AS lex_text FROM (SELECT *, unnest(range(1, len(lex_en) + 1)) AS i FROM entries WHERE size = 1)", fixed=True)
def single_triple_tasks(spark, d):
    return xml.single_triple_entries(_scanned(spark, d)).select("split", "category", "eid", "mtriple", "lex_id", "lex_text")


@query("SELECT split, category, eid, array_to_string(lex_es, '~') AS lex FROM entries", fixed=True)
def lex_lookup(spark, d):
    return xml.lex_index(_scanned(spark, d)).select("split", "category", "eid", F.array_join("lex", "~").alias("lex"))


@query("SELECT base_id AS docno, n AS n_triples FROM chosen WHERE n >= 4", fixed=True)
def min_triples_docs(spark, d):
    kept, _ = collection.eligible(fixture.entries(spark, d))
    docs = collection.wide_docs(collection.tripleset_docs(collection.mix_entries(kept)), collection.text_docs(kept), min_triples=4)
    return docs.select("docno", F.col("n_triples").cast("long"))


@query("SELECT base_id FROM entries WHERE size >= 3 AND len(mtriples) >= 3 AND len(striples) > 0 AND len(lex_en) > 0", fixed=True)
def mapping_variant(spark, d):
    """The older mapping: three triples or more, Spanish triples that needn't be as many, no Spanish text wanted."""
    return collection.eligible(fixture.entries(spark, d), min_triples=3, aligned=False, spanish_text=False)[0].select("base_id")


@query("SELECT l_orderkey, l_linenumber, cast(CASE l_orderkey % 4 WHEN 0 THEN l_linenumber WHEN 1 THEN l_linenumber ELSE -1 END AS int) AS n FROM lineitem")
def whole_numbers(spark, d):
    k, n = F.col("l_orderkey") % 4, F.col("l_linenumber").cast("string")
    said = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".0"))).when(k == 2, F.concat(n, F.lit(" triples")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", whole_number(said, -1).alias("n"))


def _hashed(words: str) -> str:
    """SQL: the encoder's counts of a list of words, as a list by dimension: the dimension is the low bits of the hash's first half, the sign its first bit."""
    place = "cast(16 * (instr('0123456789abcdef', substr(md5(w), 15, 1)) - 1) + instr('0123456789abcdef', substr(md5(w), 16, 1)) - 1 AS int) % 64"
    return f"list_transform(range(64), lambda j: coalesce(list_sum(list_transform({words}, lambda w: CASE WHEN {place} <> j THEN 0 WHEN substr(md5(w), 1, 1) >= '8' THEN 1 ELSE -1 END)), 0))"


@query(f"""SELECT base_id, lex_idx, round(s, 5) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY round(s, 5) DESC, lex_idx) AS place FROM (
    SELECT base_id, lex_idx, coalesce(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 0), 0) AS s FROM (
      SELECT base_id, lex_idx, cast({_hashed("tw")} AS double[]) AS a, cast({_hashed("xw")} AS double[]) AS b FROM (
        SELECT base_id, cast(i - 1 AS int) AS lex_idx, list_filter(string_split(lower(array_to_string(mtriples, ' ')), ' '), lambda w: w <> '') AS tw, list_filter(string_split(lower(lex_en[i]), ' '), lambda w: w <> '') AS xw
        FROM (SELECT *, unnest(range(1, len(lex_en) + 1)) AS i FROM entries)))))
WHERE place = 1""", fixed=True)
def closest_text_by_encoder(spark, d):
    rows = fixture.entries(spark, d).select("base_id", F.array_join("mtriples", " ").alias("triples"), F.posexplode("lex_en").alias("lex_idx", "lex"))
    return collection.closest_by_encoder(rows, ["base_id"], "triples", "lex", lambda df, column, name: embed(df, column, HashingEncoder, name)).select("base_id", "lex_idx", F.col("similarity"))
