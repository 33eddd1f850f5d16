"""Hand-worked cases and properties of the collection, retrieval and evaluation operators."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import edits, model_output, numbers, questions, rules, stable, text
from ridgeline.operators import collection, encoders, fusion, metrics, qrels, report, retrieval
from ridgeline.operators import questions as qa
from ridgeline.plans import matrix
from ridgeline.sources import tables, xml
from ridgeline.streaming import resume


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


# --- text


def test_normalisers(spark):
    c = F.col("x")
    assert values(spark, text.normalize_ws(c), [" a\t b \n", None, ""]) == ["a b", "", ""]
    assert values(spark, text.split_camel(c), ["birthPlace", "ABCTeam", "añoÑu"]) == ["birth Place", "ABC Team", "año Ñu"]
    assert values(spark, text.normalize_triple_text(c), ['Alan_Bean | birthPlace | "Wheeler, Texas"@en ||| A||B']) == ["Alan Bean birth Place Wheeler, Texas . A . B"]
    assert values(spark, text.normalize_triple_text(c, True), ["ﬁsh | x² | y"]) == ["fish x2 y"]
    assert values(spark, text.normalize_text_text(c), ["The “Big_Bang” isn’t ¿here?", None]) == ["the big bang isn t here", ""]
    assert values(spark, text.tokenize(c), ["A_b, c-d É9!", "", None]) == [["a", "b", "c", "d", "é9"], [], []]
    assert values(spark, text.concat_field(c, F.lit("t")), ["a . b"]) == ["[TRIPLES] a . b [TEXT] t"]
    assert values(spark, text.split_triples(c), ["a | b ||| c | d", "a|||b", "a\n\n b ", None]) == [["a | b", "c | d"], ["a", "b"], ["a", "b"], []]
    assert values(spark, text.whole_number(c, 1), ["3", "2.0", "x", None]) == [3, 2, 1, 1]
    assert values(spark, text.norm_text(c), ["¿Qué  AÑO, l'any?"]) == ["que ano, l any"]


def test_ids(spark):
    c = F.col("x")
    ids = ["tripleset__train__Airport__Id1__2triples__mix", "text__dev__A__Id2__1triples__en", "train__A__Id3__1triples"]
    assert values(spark, text.base_id_of(c, ["en", "es", "mix"]), ids) == ["train__Airport__Id1__2triples", "dev__A__Id2__1triples", "train__A__Id3__1triples"]
    assert values(spark, text.lang_of(c, ["en", "es", "mix"]), [*ids, "text__a__es__12"]) == ["mix", "en", None, "es"]
    row = spark.range(1).select(text.tripleset_id(F.lit("b"), F.lit("en")), text.text_id(F.lit("b"), F.lit("es"), F.lit(3)), text.entry_id(F.lit("dev"), F.lit("C"), F.lit("Id1"), F.lit(2))).first()
    assert tuple(row) == ("tripleset__b__en", "text__b__es__3", "dev__C__Id1__2triples")


def test_stable_functions_equal_python(spark):
    import hashlib
    import random

    keys = [f"k{i}" for i in range(50)]
    got = values(spark, stable.stable_index(F.col("x"), F.lit(7), 42), keys)
    assert got == [int(hashlib.md5(f"42::{k}".encode()).hexdigest(), 16) % 7 for k in keys]

    def pattern(key, n):
        rng = random.Random(int(hashlib.md5(f"42::mix::{key}".encode()).hexdigest(), 16) % 2**32)
        n_en = n // 2 + (1 if n % 2 and rng.random() < 0.5 else 0)
        places = set(rng.sample(range(n), n_en))
        return ["en" if i in places else "es" for i in range(n)]

    df = spark.createDataFrame([(k, 2 + i % 6) for i, k in enumerate(keys)], "x string, n int")
    for r in df.select("x", "n", stable.mixed_pattern("x", "n", F.lit(42)).alias("p"), stable.mixed_pattern_by_hash(F.col("x"), F.col("n")).alias("h")).collect():
        assert r.p == pattern(r.x, r.n) and len(r.h) == r.n and abs(2 * r.h.count("en") - r.n) <= 1


def test_numbers(spark):
    c = F.col("x")
    cases = {"3800.0": [3800.0], "3.800,0": [3800.0], "3,800.5": [3800.5], "-3,3528": [-3.3528], "−7": [-7.0], "1.234": [1.234, 1234.0], "1.234.567": [1234567.0], "1,234,567": [1234567.0], "x": [], "12.": [12.0], "1234,567": [1234.567]}
    assert values(spark, numbers.number_variants(c), list(cases)) == list(cases.values())
    assert values(spark, numbers.number_tokens(c), ["It is 3.800,5 m (12, or -4)."]) == [["3.800,5", "12", "-4"]]
    df = spark.createDataFrame([("3,800 m", "3.800 metros"), ("3800 m", "380"), ("none", "7")], "a string, b string")
    assert [r[0] for r in df.select(numbers.missing_numbers(F.col("a"), F.col("b"))).collect()] == [[], ["3800"], []]


def test_model_output(spark):
    c = F.col("x")
    assert [r and r["a"] for r in values(spark, model_output.parse_json(c, "a int"), ['{"a": 1}', '<think>{"a": 9}</think> so: {"a": 2} ok', "no", None])] == [1, 2, None, None]
    assert values(spark, model_output.parse_ok(c), ['{"ok": true}', 'x "ok" : False', "it is TRUE", "false", "", None]) == [True, False, True, False, None, None]
    ok = lambda a, b: spark.range(1).select(*model_output.yesno_check(F.lit(a), F.lit(b))).first()
    assert ok(" Yes", "sí")[0] and ok("no", "No")[0] and not ok("yes", "no")[0] and ok("x", "no")[1] == "Unexpected EN: 'x'"
    assert values(spark, model_output.missing_kinds(c), ["yes_question; extractive_questions(1_missing)", "", None]) == [["yes_q", "extractive"], [], []]


def test_question_punctuation(spark):
    c = F.col("x")
    assert values(spark, questions.normalize_english_question(c), ['" what is  it ?"', "¿who ,me", "", None, "?"]) == ["What is it?", "Who, me?", "", "", ""]
    spanish = ["que país es", "¿En que año fue ??", "“Cuantos son?”", "según que ley", "La casa", ""]
    assert values(spark, questions.normalize_spanish_question(c), spanish) == ["¿Qué país es?", "¿En qué año fue?", "¿Cuántos son?", "¿Según qué ley?", "¿La casa?", ""]


def corrected(spark, said, proposed, lang="en", spelling=False):
    df = spark.createDataFrame([(said, proposed)], f"x string, e {edits.EDITS}")
    return df.select(edits.edited(F.col("x"), F.col("e"), lang, spelling)).first()[0]


def test_safe_edits(spark):
    said = "the order of Robert Smith has 12 item's"
    edit = lambda a, n, new, cat, rule="R": (a, n, new, rule, cat, "")
    proposed = [edit(0, 3, "The", "CASING"), edit(13, 6, "Rupert", "GRAMMAR"), edit(30, 2, "13", "GRAMMAR"), edit(26, 3, "had", "GRAMMAR"), edit(33, 6, "items", "TYPOS"), edit(27, 1, "x", "GRAMMAR")]
    fixed = corrected(spark, said, proposed)
    assert fixed.text == "The order of Robert Smith had 12 item's" and [e["after"] for e in fixed.log] == ["The", "had"]
    assert corrected(spark, "a  b", [(1, 2, " ", "R", "WHITESPACE", "m")]).text == "a b"
    assert corrected(spark, None, None) == ("", []) and corrected(spark, None, proposed) == ("", []) and corrected(spark, "abc", None) == ("abc", [])
    # spelling only on demand, one small word for one; two insertions at a place, and one where another edit starts
    assert corrected(spark, "the huose", [edit(4, 5, "house", "TYPOS")]).text == "the huose"
    assert corrected(spark, "the huose", [edit(4, 5, "house", "TYPOS", "MORFOLOGIK_RULE_EN")], spelling=True).text == "the house"
    assert corrected(spark, "who is it", [edit(3, 0, ",", "PUNCTUATION"), edit(0, 3, "Who", "CASING"), edit(4, 2, "was", "MISC"), edit(4, 0, "-", "PUNCTUATION")]).text == "Who, -was it"
    assert corrected(spark, "el dia 😀 de", [edit(9, 2, "del", "GRAMMAR")], "es").text == "el dia 😀 del"


def test_protected_places(spark):
    df = spark.createDataFrame([("Who met NASA in Cape Canaveral on 3,5?",), ("A big McLaren. Then",), ("Here Robert stays. Robert goes",), ("",), (None,)], "x string")
    assert [[tuple(s) for s in r[0]] for r in df.select(edits.protected("x")).collect()] == [[(8, 33), (34, 37)], [(6, 13)], [(0, 11)], [], []]


def test_quotes_of_any_depth(spark):
    c = questions.strip_outer_quotes(F.col("x"))
    assert values(spark, c, ["\"" * 9 + " a " + "\"" * 9, "'a", "\"'\"", "“ ‘a’ ” b", "' “a” '", "\"\"", "", "\"" * 7]) == ["a", "'a", "'", "“ ‘a’ ” b", "a", "", "", "\""]


def test_distance(spark):
    assert spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(questions.syntactic_distance("a", "b")).first()[0] == pytest.approx(0.25)


def test_translation_rules(spark):
    def errors(language, *said):
        df = spark.createDataFrame([said], "qe string, ae string, q string, a string, lex string")
        return df.select(rules.translation_errors(*[F.col(c) for c in df.columns], language)).first()[0]

    assert errors(rules.SPANISH, "Who led it?", "Ann", "¿Quién lo dirigió?", "Ann", "Ann lo dirigió") == []
    assert errors(rules.SPANISH, "How many meters above sea level is it?", "3.8", "¿A qué altura está el lugar?", "3,8", "") == []
    assert errors(rules.SPANISH, "When was it?", "Yes", "What is it", None, "") != []
    assert errors(rules.CATALAN, "Where is it?", "Vic", "On és la vila?", "Vic", "és a Vic") == []
    assert len(errors(rules.CATALAN, "Where is it?", "no", "¿Quin?", "si", "")) == 4
    assert errors(rules.SPANISH, None, None, None, None, None) == ["empty question_es", "question_es is too short", "empty answer_es"]


# --- metrics and fusion


def run_of(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, score double, rank int")


def test_metrics_by_hand(spark):
    run = run_of(spark, [("q", d, 10.0 - i, i + 1) for i, d in enumerate("axbyz")] + [("q", "a", 0.0, 9), ("unjudged", "a", 1.0, 1)])
    judged = spark.createDataFrame([("q", d, 1) for d in "abc"] + [("q", "x", 0), ("other", "a", 1)], "qid string, docno string, relevance int")
    rows = metrics.per_query(run, judged).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["AP"], r["P@5"], r["Recall@5"], r["MRR@5"]) == pytest.approx((0.555556, 0.4, 0.666667, 1), abs=1e-6)
    assert r["nDCG@5"] == pytest.approx(0.703918, abs=1e-6) and r["P@10"] == pytest.approx(0.2)
    every = {r.qid: r for r in metrics.per_query(run, judged, include_unretrieved=True).collect()}
    assert set(every) == {"q", "other"} and every["other"]["AP"] == 0 and every["other"]["nDCG@10"] == 0


def test_fusion_by_hand(spark):
    one, two = run_of(spark, [("q", d, 3.0 - i, i + 1) for i, d in enumerate("cab")]), run_of(spark, [("q", d, 3.0 - i, i + 1) for i, d in enumerate("acz")])
    fused = fusion.reciprocal_rank_fusion(one, two).orderBy("rank").collect()
    assert [r.docno for r in fused] == ["a", "c", "b", "z"] and fused[0].score == pytest.approx(0.016261, abs=1e-6) and fused[2].score == pytest.approx(0.007937, abs=1e-6)
    swapped = fusion.reciprocal_rank_fusion(two, one).orderBy("rank").collect()
    assert [(r.docno, r.score) for r in fused] == [(r.docno, r.score) for r in swapped]
    flat = run_of(spark, [("q", "a", 4.0, 1), ("q", "b", 4.0, 2)])
    assert {r.score for r in fusion.score_fusion(flat, flat).collect()} == {0.0}
    union = fusion.candidate_union(one, two).orderBy("rank").collect()
    assert [(r.docno, r.score) for r in union] == [("a", 3.0), ("c", 3.0), ("b", 1.0), ("z", 1.0)]


def test_cube_keeps_data_nulls_apart(spark):
    m = spark.createDataFrame([("m", "r", "en", None, 1.0), ("m", "r", "es", "dev", 0.0)], "method string, representation string, query_lang string, split string, v double")
    m = m.withColumns({"doc_lang": F.lit("en"), "scenario": F.lit("s"), "question_type3": F.lit("yes"), "n_relevant": F.lit(1), **{c: F.col("v") for c in metrics.metric_columns()}})
    cube = metrics.summary_cube(m).collect()
    whole = [r for r in cube if all(r[d] == "ALL" for d in metrics.DIMENSIONS)]
    assert len(whole) == 1 and whole[0].n_queries == 2 and whole[0].AP == 0.5
    assert sum(r.split is None for r in cube) == 16 and {r.split for r in cube} == {None, "dev", "ALL"}


def test_properties_of_ranks(spark):
    import random

    rng = random.Random(0)
    run = run_of(spark, [(f"q{q}", f"d{d}", float(rng.randrange(5)), d + 1) for q in range(5) for d in range(20)])
    judged = spark.createDataFrame([(f"q{q}", f"d{rng.randrange(25)}", 1) for q in range(5) for _ in range(4)], "qid string, docno string, relevance int")
    for r in metrics.per_query(run, judged, (1, 5, 10)).collect():
        assert 0 <= r["AP"] <= 1 and r["Recall@1"] <= r["Recall@5"] <= r["Recall@10"] <= 1 and all(0 <= r[f"nDCG@{k}"] <= 1 for k in (1, 5, 10))
    top = fusion.score_fusion(run, run, k=7).groupBy("qid").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r.r == list(range(1, 8)) for r in top)


# --- retrieval


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([("a", "red sea red"), ("b", "blue sea"), ("c", "")], "docno string, text string")
    asked = spark.createDataFrame([("1", "red sea red"), ("2", "none"), ("3", None)], "qid string, query string")
    got = {(r.qid, r.docno): r.score for r in retrieval.bm25(docs, asked, k=10).collect()}
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / (5 / 3)))
    assert got == {("1", "a"): round(2 * idf(3, 1) * part(2, 3) + idf(3, 2) * part(1, 3), 6), ("1", "b"): round(idf(3, 2) * part(1, 2), 6)}
    padded = retrieval.bm25(docs, asked, k=2, pad_zero=True).orderBy("qid", "rank").collect()
    assert [(r.qid, r.docno, r.score) for r in padded if r.qid != "1"] == [("2", "a", 0.0), ("2", "b", 0.0), ("3", "a", 0.0), ("3", "b", 0.0)]


def test_dense_blocks_and_encoder(spark):
    docs = encoders.embed(spark.createDataFrame([(k, f"word{k % 7} and {k}") for k in range(60)], "docno long, text string"), "text", encoders.HashingEncoder, prefix="passage: ")
    asked = docs.where("docno < 9").select(F.col("docno").alias("qid"), "embedding")
    plain = docs.alias("d").crossJoin(asked.alias("q")).select("q.qid", "d.docno", F.round(retrieval.dot(F.col("q.embedding"), F.col("d.embedding")), 6).alias("score"))
    from ridgeline.operators.topk import top_k

    expected = sorted(map(tuple, top_k(plain, 5).collect()))
    for block in (4, 512):
        assert sorted(map(tuple, retrieval.dense(docs, asked, 5, block=block).select("qid", "docno", "score", "rank").collect())) == expected
    assert retrieval.dense(docs, asked.where("false"), 5).count() == 0


def test_multi_vectors_by_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    vecs = [np.round(rng.normal(size=(int(rng.integers(0, 5)), 3)), 3) for _ in range(40)]
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)] + [(99, None)], "docno long, vecs array<array<double>>").repartition(3)
    asked = docs.where("docno < 12").withColumnRenamed("docno", "qid")
    sim = lambda q, d: round(float((q @ d.T).max(1).sum()), 6) if len(q) and len(d) else 0.0
    expected = sorted((q, d, sim(vecs[q], vecs[d]), rank) for q in range(12) for rank, d in enumerate(sorted(range(40), key=lambda d: (-sim(vecs[q], vecs[d]), d))[:6], 1))
    for most, cells in ((4096, 1 << 24), (5, 16)):
        monkeypatch.setattr(retrieval, "MOST_VECTORS", most)
        monkeypatch.setattr(retrieval, "MOST_CELLS", cells)
        assert sorted(map(tuple, retrieval.multi_vector(docs, asked, 6).select("qid", "docno", "score", "rank").collect())) == expected


def test_bm25_and_sparse_without_broadcast(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "", None, "b b", "zz a", "c"] * 4)], "docno long, text string")
    asked = spark.createDataFrame([(0, "a b"), (1, "c c q"), (2, ""), (3, None)], "qid long, query string")
    key = lambda df: sorted(map(tuple, df.collect()))
    small = key(retrieval.bm25_scores(docs, asked))
    assert small and small == key(retrieval.bm25_scores(docs, asked, most_broadcast=0))
    d, q = retrieval.tf_weights(docs, "docno", "text"), retrieval.tf_weights(asked, "qid", "query")
    small = key(retrieval.sparse_scores(d, q))
    assert small and small == key(retrieval.sparse_scores(d, q, most_broadcast=0))
    assert {(r.term, r.docno, r.tf, r.dl) for r in retrieval.postings(docs).where("docno < 4").collect()} == {("a", 0, 2, 4), ("b", 0, 1, 4), ("c", 0, 1, 4), ("b", 3, 2, 2)}


def test_best_of_pairs_without_a_shuffle_of_pairs(spark, monkeypatch):
    import math
    import random

    from ridgeline.operators.topk import top_k

    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    docs = spark.createDataFrame([(f"d{k}", say(rng.randrange(6))) for k in range(50)] + [("x", None)], "docno string, text string").repartition(3)
    asked = spark.createDataFrame([(k, say(rng.randrange(5))) for k in range(9)] + [(3, "b b"), (77, "zz"), (78, None)], "qid long, query string")
    d, q = retrieval.tf_weights(docs, "docno", "text"), retrieval.tf_weights(asked, "qid", "query")
    signed = q.withColumn("weight", F.when(F.col("dim") < "d", -F.col("weight")).when(F.col("dim") < "f", 0.0).otherwise(F.col("weight")))
    key = lambda df: sorted(map(tuple, df.select("qid", "docno", "score", "rank").collect()))
    right = [key(top_k(df, 4)) for df in (retrieval.bm25_scores(docs, asked), retrieval.sparse_scores(d, q), retrieval.sparse_scores(d, signed))]
    for limits in ({}, {"MOST_TERMS": 7, "QUERY_BLOCK": 2, "MOST_WEIGHTS": 5, "DOCUMENT_CELLS": 30}):
        for name, value in limits.items():
            monkeypatch.setattr(retrieval, name, value)
        found = [retrieval.bm25(docs, asked, 4), retrieval.sparse(d, q, 4), retrieval.sparse(d, signed, 4)]
        assert [key(df) for df in found] == right
        assert key(retrieval.tf_sparse(docs, asked, 4)) == right[1]
        for df in found:  # only the tasks' best rows are left to be ranked
            assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert retrieval.bm25(docs, asked.where("false"), 4).count() == 0
    # Rows of one id are one document; lengths are of rows
    twice = retrieval.bm25(spark.createDataFrame([("a", "x y"), ("a", "x y"), ("b", "y")], "docno string, text string"), spark.createDataFrame([(1, "x")], "qid long, query string")).collect()
    assert [(r.docno, r.score) for r in twice] == [("a", round(math.log(1 + 2.5 / 1.5) * 2 * 1.9 / (2 + 0.9 * (0.6 + 0.4 * 2 / (5 / 3))), 6))]


def test_every_run_of_the_matrix(spark):
    from ridgeline.plans import experiment

    names = ["red fox", "blue whale", "green tea", "red tea", "old fox"]
    docs = spark.createDataFrame([(f"d{k}", f"{n} runs {k}", f"the {n} is here", f"{n} runs {k} the {n} is here") for k, n in enumerate(names)], "docno string, triples_en string, text_en string, concat_en string")
    queries = spark.createDataFrame([(f"q{k}", f"where is the {n}", "en", "test", "yes") for k, n in enumerate(names)], "qid string, query string, query_lang string, split string, question_type3 string")
    one = ("en",)
    runs = list(matrix.matrix(query_langs=one, triple_langs=one, concat_langs=one, text_langs=one, hybrid_langs=one, top_k_base=4, top_k_final=3))
    done = experiment.execute(runs, docs, queries)
    assert list(done) == [r.name for r in runs] and len(runs) == 22
    depth = {r.name: r.k for r in runs}
    for name, df in done.items():
        rows = df.collect()
        assert {r.qid for r in rows} == {f"q{k}" for k in range(5)} and max(r["rank"] for r in rows) <= depth[name], name
    best = {r.qid: r.docno for r in done["multivector__text__qen_den"].where("rank = 1").collect()}
    assert best == {f"q{k}": f"d{k}" for k in range(5)}
    cascade = done["multivector__hybrid_cascade__qen_den"].collect()
    pool = {(r.qid, r.docno) for r in done["bm25__hybrid_union_candidates__qen_den"].collect()}
    assert {(r.qid, r.docno) for r in cascade} <= pool and {r.qid: r.docno for r in cascade if r["rank"] == 1} == best
    with pytest.raises(ValueError, match="no such method"):
        experiment.execute([matrix.Run("other", "text", "en", "en", 3)], docs, queries)
    with pytest.raises(ValueError, match="aren't there"):
        experiment.execute([matrix.Run("bm25", "hybrid_rrf", "en", "en", 3, ("x", "y"))], docs, queries)


def test_furthest_pairs_by_brute_force(spark):
    import random

    rng = random.Random(2)
    pool = [(f"k{k % 3}", "".join(rng.choice("abc") for _ in range(6)) + str(i), k % 3 == 0 or (k % 3 == 1 and i == 4)) for k in range(3) for i in range(11)]
    df = spark.createDataFrame(pool, "category string, question string, is_original boolean")
    got = {r.category: (r.question_a, r.question_b, r.distance) for r in qa.diverse_pair(df, ["category"], lambda a, b: F.levenshtein(a, b).cast("double"), [F.col("question")], block=3).collect()}

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return float(row[-1])

    for category in ("k0", "k1", "k2"):
        own = sorted((not o, q) for c, q, o in pool if c == category)
        n = sum(not late for late, _ in own)
        used = [q for late, q in own if n < 2 or not late]
        pairs = [(-apart(a, b), i, j, a, b) for i, a in enumerate(used) for j, b in enumerate(used) if i < j and (n != 1 or i == 0)]
        far, _, _, a, b = min(pairs)
        assert got[category] == (a, b, -far)


def test_max_sim_and_unit(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.2], [0.1, 0.9]]), ([], [[1.0, 0.0]])], "q array<array<double>>, d array<array<double>>")
    assert [r[0] for r in retrieval.max_sim(df, "q", "d").collect()] == pytest.approx([1.4, 0.0])
    assert spark.range(1).select(retrieval.unit(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == pytest.approx([0.6, 0.8])


def test_generator_column(spark):
    df = spark.createDataFrame([("a",), (None,)], "p string")
    assert [r.output for r in encoders.generate(df, "p", lambda: lambda batch: [x.upper() for x in batch]).collect()] == ["A", ""]


# --- sources


CORPUS = """<benchmark><entries>
<entry category="A" eid="Id1" size="2" shape="(X)" shape_type="NA"><originaltripleset><otriple>o1</otriple></originaltripleset>
<modifiedtripleset><mtriple> a | b | c </mtriple><mtriple>d | e | f</mtriple></modifiedtripleset><spanishtripleset><striple>a | b | c</striple><striple> </striple></spanishtripleset>
<lex lang="en" lid="1">One.</lex><lex lid="2">Two.</lex><lex lang="es" lid="3">Uno.</lex><lex lang="ca" lid="4">U.</lex></entry>
<entry category="A" eid="Id2" size="x"><modifiedtripleset><mtriple>g | h | i</mtriple></modifiedtripleset><lex lang="en">Three.</lex></entry>
<entry category="A" eid="Id3" size="1"><modifiedtripleset><mtriple> </mtriple></modifiedtripleset></entry>
</entries></benchmark>"""


def test_corpus_scan(spark, tmp_path):
    folder = tmp_path / "corpus" / "dev" / "2triples"
    folder.mkdir(parents=True)
    (folder / "A.xml").write_text(CORPUS)
    paths = xml.layout_paths(spark, str(tmp_path / "corpus"))
    (folder / "B.xml").write_text(CORPUS.replace("<lex lid", "<lex lid=").replace("Id", "Broken"))
    assert len(paths) == 1
    rows = {r.eid: r for r in xml.scan_entries(spark, paths).collect()}
    assert set(rows) == {"Id1", "Id2"}
    r = rows["Id1"]
    assert (r.split, r.size_dir, r.xml_file, r.size, r.mtriples, r.striples, r.otriples) == ("dev", 2, "A.xml", 2, ["a | b | c", "d | e | f"], ["a | b | c"], ["o1"])
    assert (r.lex_en, r.lex_es, r.lex_ca) == (["One.", "Two."], ["Uno."], ["U."]) and rows["Id2"].size == 1 and rows["Id2"].striples == []
    entries = xml.scan_entries(spark, paths)
    assert [(x.eid, x.lex_id, x.lex_text) for x in xml.single_triple_entries(entries).collect()] == [("Id2", 0, "Three.")]
    assert {x.eid: x.lex for x in xml.lex_index(entries).collect()} == {"Id1": ["Uno."], "Id2": []}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x",\nor not', 1.5)], "id string, t string, v double")
    for name in ("x.parquet", "x.csv", "x.tsv"):
        tables.write_table(df, str(tmp_path / name))
        assert [tuple(map(str, r)) for r in tables.read_table(spark, str(tmp_path / name)).collect()] == [("a", 'say "x",\nor not', "1.5")]
    assert tables.table_path(spark, str(tmp_path), "x").endswith("x.parquet")
    with pytest.raises(FileNotFoundError):
        tables.table_path(spark, str(tmp_path), "y")
    with pytest.raises(ValueError):
        tables.read_table(spark, "a.xlsx")
    with pytest.raises(ValueError):
        tables.require(df, "nope")
    assert len(tables.expand_paths(spark, [f"{tmp_path}/x.*"])) == 3
    (tmp_path / "s.csv").write_text("method;represent;query_lang;doc_lang;scenario;split;question_t;n_queries;nDCG@10\n bm25 ;kg;en;en;en_to_en;ALL;ALL;3;0,25\n")
    r = tables.read_summary(spark, str(tmp_path / "s.csv"), {"bm25": "BM25"}, strict=True).first()
    assert (r.method, r.representation, r.n_queries, r["nDCG@10"]) == ("BM25", "kg", 3.0, 0.25)
    with pytest.raises(ValueError):
        tables.read_summary(spark, str(tmp_path / "s.csv"), {"other": "x"}, strict=True)
    tables.write_json(spark, {"n": 1}, str(tmp_path / "m.profile.json"))
    assert json.loads((tmp_path / "m.profile.json").read_text()) == {"n": 1} and tables.read_profiles(spark, str(tmp_path / "*.profile.json")).first().profile_path.endswith("m.profile.json")
    tables.write_fields(df, str(tmp_path / "f.csv"), ["id", "extra"])
    assert tables.read_table(spark, str(tmp_path / "f.csv")).columns == ["id", "extra"]


def test_runs(spark, tmp_path):
    run = run_of(spark, [("1", "a", 2.0, 1), ("1", "b", 1.0, 2)])
    tables.save_run(run, str(tmp_path / "r.parquet"), method="bm25", query_lang="en", doc_lang="es")
    back = spark.read.parquet(str(tmp_path / "r.parquet"))
    assert back.columns == list(tables.RUN_COLUMNS) and back.first().scenario == "en_to_es"
    assert tables.load_run(back, "text", 1).count() == 1
    assert tables.effective_doc_lang("text", "mix") == "en" and tables.representation_column("concat", "mix") == "concat_mix"
    with pytest.raises(ValueError):
        tables.representation_column("other", "en")


def test_resume(spark, tmp_path):
    path, tasks = str(tmp_path / "out"), spark.createDataFrame([(k, None if k == 3 else "x") for k in range(10)], "k long, x string")
    assert resume.run_resumable(tasks.where("k < 4"), ["k", "x"], path, lambda df: df) == 1
    assert resume.run_resumable(tasks, ["k", "x"], path, lambda df: df, batches=3) >= 1
    assert resume.run_resumable(tasks, ["k", "x"], path, lambda df: df, batches=3) == 0
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(10))
    p = resume.Profile(method="bm25")
    with p.stage("index"):
        pass
    row = p.finish(n_docs=10, n_queries=0)
    assert row["index_time_s"] >= 0 and row["docs_per_second_total"] > 0 and row["queries_per_second_total"] is None


def test_matrix():
    runs = list(matrix.matrix())
    names = [r.name for r in runs]
    assert len(names) == len(set(names)) == 3 * (3 * (3 + 2 + 3) + 27 + 8 + 3)
    assert all(i in names for r in runs for i in r.inputs)
    assert {r.k for r in runs if r.method == "dense" and r.representation == "text"} == {100}


# --- collections and question sets


def test_inventory_faults(spark):
    docs = spark.createDataFrame([("b1", lang, 2) for lang in ("en", "es", "mix")] + [("b2", "en", 1)], "base_id string, lang string, size int")
    texts = spark.createDataFrame([("b1", lang, 2, lang) for lang in ("en", "es", "mix")], "base_id string, lang string, size int, text string")
    assert {r.fault: r.n for r in collection.inventory_faults(docs, texts).collect()} == {"tripleset_only": 1, "text_only": 0, "not_in_every_language": 1, "size_distribution": 1, "text_mix_differs": 1}


def test_votes_and_correction(spark):
    v = spark.createDataFrame([("q", 0, True, False, "b"), ("q", 1, True, False, "a"), ("q", 2, None, None, "z"), ("p", 0, True, True, None), ("p", 1, False, False, "")], "k string, judge int, answerable boolean, correct boolean, corrected_answer string")
    rows = {r.k: r for r in qa.majority_vote(v, ["k"]).collect()}
    assert (rows["q"].judges_used, rows["q"].answerable, rows["q"].correct, rows["q"].judge_corrected_answer) == (2, True, False, "b")
    assert (rows["p"].answerable, rows["p"].correct, rows["p"].judge_corrected_answer) == (False, False, None)


def test_selection(spark):
    rows = [("c", "e", "yes_no", "y1", "Yes", None, "CORRECTED"), ("c", "e", "yes_no", "y2", "x", "yes", ""), ("c", "e", "yes_no", "n1", "No", None, "")]
    rows += [("c", "e", "extractive", q, "a", None, f) for q, f in (("what is far", ""), ("what is near", ""), ("zzz qqq", ""), ("corrected one", "C"))] + [("c", "short", "yes_no", "y", "yes", None, "")]
    df = spark.createDataFrame(rows, "category string, eid string, question_type string, question string, answer string, corrected_answer string, correction_flag string")
    got = {r.selected_role: (r.question, r.selection_source) for r in qa.select_four(df).collect()}
    assert set(got) == {"yes_q", "no_q", "extractive_1", "extractive_2"} and got["yes_q"] == ("y2", "original") and got["no_q"] == ("n1", "original")
    pool = df.where("question_type = 'extractive'").withColumn("is_original", F.col("correction_flag") == "")
    pair = qa.diverse_pair(pool, ["category", "eid"]).first()
    assert "zzz qqq" in (pair.question_a, pair.question_b) and "corrected one" not in (pair.question_a, pair.question_b)
    chosen = {r.question for r in qa.select_four(df, pairs=qa.diverse_pair(pool, ["category", "eid"])).collect()}
    assert {pair.question_a, pair.question_b} <= chosen


def test_merge_and_placeholders(spark):
    schema = "split string, category string, eid string, lex_id string, question_idx int, question_type string, question string, answer string, tag string"
    one = spark.createDataFrame([("s", "c", "e", "0", 3, "yes_no", "q", "a", "old"), ("s", "c", "e", "0", 4, "", "", "", "old"), ("s", "c", "f", "0", 0, "", "", "", "old")], schema)
    two = spark.createDataFrame([("s", "c", "e", "0", 0, "yes_no", "q", "a", "new"), ("s", "c", "e", "0", 1, "extractive", "p", "b", "new")], schema)
    rows = sorted((r.eid, r.question_idx, r.question, r.tag) for r in qa.merge_questions(one, two).collect())
    assert rows == [("e", 0, "p", "new"), ("e", 1, "q", "old"), ("f", 0, "", "old")]


def test_labels_of_fused_runs(spark):
    one = spark.createDataFrame([("bm25", "en", "en")], "method string, query_lang string, doc_lang string")
    assert tuple(fusion.fused_labels(one, one).first()) == ("bm25", "en", "en")
    assert tuple(fusion.fused_labels(one, spark.createDataFrame([("dense", "es", "es"), ("dense", "es", "en")], one.schema)).first()) == ("hybrid", "mixed", "mixed")


def test_reports(spark):
    s = spark.createDataFrame([("m", "kg", "en", "es", 1.0, 0.2), ("m", "text", "en", "es", 3.0, 0.4), ("m", "rrf", "en", "es", 2.0, 0.7), ("m", "rrf", "en", "es", 2.0, None), ("m", "odd", "en", "es", 0.0, 0.9)], "method string, representation string, query_lang string, doc_lang string, n_queries double, `nDCG@10` double")
    rows = report.by_representation(s).orderBy("position").collect()
    assert [(r.representation_clean, r["nDCG@10"]) for r in rows] == [("triples", 0.2), ("text", 0.4), ("hybrid_rrf", 0.7)]
    assert [(r.hybrid, r.mean_gain) for r in report.hybrid_gain(s).collect()] == [("hybrid_rrf", 0.3)]


def test_judgements_by_fact(spark):
    docs = spark.createDataFrame([("d1", "a | b | c\nx | y | z", "", 2), ("d2", None, "a | b | c", 1), ("d3", "", "", 1)], "docno string, supporting_mtriples_en string, triples_en_raw string, n_triples int")
    asked = spark.createDataFrame([(1, " a | b |  c"), (2, "x | y | Z"), (3, None)], "qa_row_id long, mtriple string")
    facts = qrels.triple_docs(docs)
    assert sorted(map(tuple, qrels.relevant_docs(asked, facts).collect())) == [(1, "d1"), (1, "d2")]
    assert qrels.relevant_docs(asked, facts, 3).count() == 0
    assert {tuple(r) for r in qrels.covered_triples(facts, asked).collect()} == {("a | b | c", True), ("x | y | Z", False)}


def counted(spark, df):
    """The frame, and a counter of the rows that are made of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_sides_and_facts_are_made_once(spark):
    facts, seen = counted(spark, spark.createDataFrame([("a | b | c", "d1", 2), ("a | b | c", "d2", 3), ("x | y | z", "d1", 2)], "triple string, docno string, n_triples int"))
    asked = spark.createDataFrame([(1, "a |  b | c"), (2, "x | y | z"), (2, "a | b | c"), (3, "x | y | z")], "qa_row_id long, mtriple string")
    assert sorted(map(tuple, qrels.relevant_docs(asked, facts, 3).collect())) == [(1, "d1"), (1, "d2"), (2, "d1"), (2, "d2")]
    assert seen.value == 3
    docs, seen = counted(spark, spark.createDataFrame([("b1", lang, 2, "t") for lang in ("en", "es", "mix")], "base_id string, lang string, size int, text string"))
    assert {r.n for r in collection.inventory_faults(docs, docs).collect()} == {0} and seen.value == 6
    texts = docs.selectExpr("base_id", "lang", "0 as lex_idx", "base_id as doc_id", "text")
    triples = docs.selectExpr("base_id", "lang", "'s' as split", "'c' as category", "'e' as eid", "size", "2 as n_triples", "text as triples", "text as supporting_mtriples", "base_id as doc_id")
    wide = collection.wide_docs(triples, texts)
    assert wide.select("docno", "text_es", "n_lex_mix", "triples_mix_raw").first() == ("b1", "t", 1, "t") and dict(wide.dtypes)["n_lex_en"] == "bigint"
    assert "Expand" not in wide._jdf.queryExecution().optimizedPlan().toString()  # distinct counts would repeat every row


def test_judgements_come_once_for_all_runs(spark):
    from ridgeline.plans import experiment

    queries = spark.createDataFrame([("q1", "dev", "yes"), ("q2", "dev", "no")], "qid string, split string, question_type3 string")
    judged, seen = counted(spark, spark.createDataFrame([(q, f"d{k}", 1) for q in ("q1", "q2", "q3") for k in range(5)], "qid string, docno string, relevance int"))
    run = lambda *rows: spark.createDataFrame(rows, "qid string, docno string, score double, rank int")
    runs = {"m__text__qen_den": run(("q1", "d0", 2.0, 1), ("q1", "x", 1.0, 2)), "m__concat__qen_den": run(("q1", "x", 2.0, 1), ("q1", "d1", 1.0, 2), ("q2", "x", 1.0, 1))}
    rows = {(r.run, r.qid): (r.n_relevant, r.AP, r["MRR@5"]) for r in experiment.evaluate(runs, queries, judged).collect()}
    assert rows == {("m__text__qen_den", "q1"): (5, 0.2, 1.0), ("m__concat__qen_den", "q1"): (5, 0.1, 0.5), ("m__concat__qen_den", "q2"): (5, 0.0, 0.0)}
    plan = experiment.evaluate(runs, queries, judged)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    one = metrics.per_query(runs["m__text__qen_den"], judged).first()
    assert (one.qid, one.n_relevant, one.AP) == ("q1", 5, 0.2)
    assert {r.qid for r in metrics.per_query(runs["m__text__qen_den"], judged, include_unretrieved=True).collect()} == {"q1", "q2", "q3"}


def test_contained_by_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    say = lambda n: rng.choice(["", " ", "\n"]) + "".join(rng.choice("abc") + rng.choice([" ", "  ", "\t"]) for _ in range(n))
    docs = [(k, say(rng.randrange(30))) for k in range(80)] + [(80, None), (81, "")]
    asked = [(k, say(rng.randrange(1, 7)).strip()) for k in range(40)] + [(40, None), (41, " "), (42, "a b c a"), (43, "a b c a b")]
    df, q = spark.createDataFrame(docs, "docno long, text string").repartition(3), spark.createDataFrame(asked, "qid long, query string")
    # From a word's start; a blank stands before each
    expected = {(i, k) for i, query in asked if query and query.strip() for k, text in docs if text and any(text.startswith(query, at) and (at == 0 or text[at - 1].isspace()) for at in range(len(text)))}
    assert expected and any(len(query.split()) < 4 for i, query in asked if any(i == x for x, _ in expected))
    for most in (1 << 24, 20):
        monkeypatch.setattr(retrieval, "SPLIT_BYTES", most)
        found = retrieval.contained(df, q)
        assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert retrieval.contained(df, q.where("false")).count() == 0


def test_rerank_moves_vectors_once_a_block(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    vecs = [np.round(rng.normal(size=(int(rng.integers(0, 5)), 3)), 3) for _ in range(30)]
    docs, seen = counted(spark, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)] + [(99, None)], "docno long, vecs array<array<double>>").repartition(3))
    asked = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(vecs[:9])] + [("none", None)], "qid string, vecs array<array<double>>")
    pairs = [(q, d, 1 + (7 * d + q) % 31) for q in range(9) for d in [*range(30), 99] if (q + d) % 3]
    pool = spark.createDataFrame([(f"q{q}", d, r) for q, d, r in pairs] + [("none", 3, 1), ("other", 3, 1), ("q1", 77, 1)], "qid string, docno long, rank int")
    sim = lambda q, d: round(float((vecs[q] @ vecs[d].T).max(1).sum()), 6) if d < 30 and len(vecs[q]) and len(vecs[d]) else 0.0
    expected = [("none", 3, 0.0, 1)]
    for q in range(9):
        best = sorted((-sim(q, d), r, d) for x, d, r in pairs if x == q and r <= 25)[:5]
        expected += [(f"q{q}", d, -s + 0.0, i) for i, (s, _, d) in enumerate(best, 1)]
    for most in (1 << 22, 20):
        monkeypatch.setattr(retrieval, "MOST_NUMBERS", most)
        monkeypatch.setattr(retrieval, "SOME_DOCUMENTS", 4)
        before = seen.value
        assert sorted(map(tuple, retrieval.rerank(pool, asked, docs, 5, 25).collect())) == sorted(expected)
        assert seen.value - before == 31
    rest = retrieval.rerank(pool, asked, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "vecs" not in rest  # pairs carry no vectors
    assert retrieval.rerank(pool, asked.where("false"), docs).count() == 0


def test_documents_are_made_once_for_all_blocks(spark):
    docs, seen = counted(spark, spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "docno long, embedding array<double>"))
    assert retrieval.dense(docs, docs.withColumnRenamed("docno", "qid").where("true"), 2, block=3).count() == 40
    assert seen.value <= 3 * 20  # queries and documents, not once a block
