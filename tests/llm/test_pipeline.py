"""The pipeline's stages on the smallest tables, each against what it has to guarantee; and the registered queries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from ridgeline.llm import decontaminate, line_templates, simhash_dedup
from ridgeline.llm.common import encode, ranks_path
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    names = list(stages)
    assert names[1:] == ["quality classifier", "line dedup", "near dedup", "decontamination", "packing"]
    for name in names[1:-1]:
        assert stages[name].columns == stages["documents"].columns
        counts = stages[name].count()
        assert 0 < counts <= stages["documents"].count()


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(rows(stages["quality classifier"]))
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_recurring_runs_stay_once(stages):
    before, after = rows(stages["quality classifier"]), rows(stages["line dedup"])
    expected = {d: (kept, n) for d, kept, n in brute_lines([(d, r.text) for d, r in before.items()])}
    for d, r in before.items():
        kept, n = expected[d]
        if d in after:
            assert after[d] == r if not n else [u.decode() for u in line_templates.units(after[d].text)[::2] if u.strip()] == kept and after[d].n_chars == len(after[d].text)
        else:
            assert n and len(" ".join(kept).split()) < line_templates.LEAST_TOKENS


def test_no_near_duplicates_are_left(stages):
    before, after = rows(stages["line dedup"]), rows(stages["near dedup"])
    fps = {d: simhash_dedup.fingerprint(r.text) for d, r in before.items()}
    kept = sorted(after)
    assert all(bin(fps[a] ^ fps[b]).count("1") > 3 for i, a in enumerate(kept) for b in kept[:i])
    for d in set(before) - set(after):  # each that went is linked, step by step, to one that stayed and is smaller
        seen, queue = {d}, [d]
        while queue:
            x = queue.pop()
            for y in before:
                if y not in seen and bin(fps[x] ^ fps[y]).count("1") <= 3:
                    seen.add(y)
                    queue.append(y)
        assert min(seen) in after and min(seen) < d


def test_no_benchmark_windows_are_left(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = decontaminate.Automaton(items)
    before, after = rows(stages["near dedup"]), rows(stages["decontamination"])
    for d, r in before.items():
        hit, _ = automaton.scan(decontaminate.words(r.text))
        if not hit.any():
            assert after[d] == r
        elif d in after:
            assert not automaton.scan(decontaminate.words(after[d].text))[0].any() and after[d].n_chars == len(after[d].text)
        else:
            assert hit.mean() > decontaminate.COVERAGE


def test_packed_ids_are_the_documents(stages):
    docs = rows(stages["decontamination"])
    seen = {}
    for r in stages["packing"].collect():
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(docs)
    for d, r in docs.items():
        ids = np.array([*encode(ranks_path(), r.text), 1], dtype="<u4")
        own = sorted(seen[d], key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own[:-1])]).tolist() and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages["packing"])


def test_pipeline_takes_hard_rows(spark, tmp_path):
    rng = random.Random(0)
    texts = [None, "", "\n", "x" * 50_000, "a b c d e f", "a b c d e f", *(" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) for _ in range(5))]
    docs = spark.createDataFrame([(k if k < 9 else None, t, None, None, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 0


def test_every_operator_has_its_query(spark):
    queries = __spark_entry__.queries()
    assert "pipeline" in queries and sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    for name in ("op3_benchmark_decontamination", "op7_secret_scans", "op9_chat_formatting"):
        assert queries[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_registered_media_query(spark, texts):
    got = {r.doc_id: r for r in __spark_entry__.queries()["op1_mpeg_audio"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        raw = text.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.n_frames == len(payload) // 192 == len(r.seek_offsets) and r.duration_num * 48000 == r.duration_den * 1152 * r.n_frames


def test_registered_near_duplicate_query(spark, texts):
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[d]) for d in ids]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in __spark_entry__.queries()["op8_simhash_near_dedup"](spark, SF).collect()}
    assert got == {d: (f"{fp:016x}", c) for d, fp, c in zip(ids, fps, brute_components(fps, ids), strict=True)}


def test_registered_line_query(spark, texts):
    got = {r.doc_id: r for r in __spark_entry__.queries()["op2_line_dedup"](spark, SF).collect()}
    for d, kept, n in brute_lines(list(texts.items())):
        assert got[d].n_dropped == n
        assert got[d].text == texts[d] if not n else [u.decode() for u in line_templates.units(got[d].text)[::2] if u.strip()] == kept


def test_registered_packing_query(spark, texts):
    pieces = __spark_entry__.queries()["op5_packing"](spark, SF).collect()
    sizes = {d: len(encode(ranks_path(), text)) + 1 for d, text in texts.items()}
    sequences, covered = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        assert p.doc_tokens == sizes[p.doc_id]
    for rows, whole in ((sequences, None), (covered, sizes)):
        for key, spans in rows.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at <= 2048 if whole is None else at == whole[key]
    assert set(covered) == set(texts) and len(sequences) * 2048 <= 1.02 * sum(sizes.values()) + 2048


def test_registered_classifier_query(spark, texts):
    rows = __spark_entry__.queries()["op6_quality_classifier"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
