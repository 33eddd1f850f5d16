"""The training-data operators against brute force, round trips and held-out accuracy, and their defined results."""

import functools
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import bfd_packing, byte_cnn, chat_format, decontaminate, line_templates, mpeg_audio, nnls_packing, secret_scan, simhash_dedup, token_attribution
from ridgeline.llm import queries as llm_queries
from ridgeline.llm.common import encode, ranks_path, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n", "\n\n\n", "a", "ß", "漢字 と 仮名", "😀" * 50, "x" * 30_000, "word " * 5_000, "\\ \\\\ <s>[INST]", "a\tb\x0bc\x1cd", "same", "same", "0", "[/INST]</s>", "é́"]


def frame(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """More columns, named like the operators' own."""
    return df.withColumns({c: F.lit(7) for c in ("fp", "fingerprint", "component_id", "score", "n_lines", "n_dropped", "n_words", "hit_words", "media", "n_bytes", "payload_bytes", "task", "units", "number", "sequence", "offset", "key", "line", "node", "position", "segment", "section", "base", "secrets", "used", "ids", "id", "_drop")})


# --- 1 media


def test_mpeg_round_trip_and_tables():
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(2000))) for _ in range(40)]
    for text in texts:
        payload = mpeg_audio.padded(text)
        assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ")
        data = mpeg_audio.write_stream(payload)
        s = mpeg_audio.read_stream(data)
        assert mpeg_audio.read_payload(data, s) == payload
        assert s.crc_good == s.crc_present == len(s.offsets) == s.table_frames == len(payload) // 192
        assert s.skipped == s.resyncs == 0 and s.table == "Xing" and len(s.toc) == 100 and s.tags["payload_bytes"] == str(len(payload))
        assert s.duration[0] * 48000 == s.duration[1] * 1152 * len(s.offsets)


def test_mpeg_resynchronises_and_verifies():
    payload = bytes(range(1, 193)) * 10
    data = mpeg_audio.write_stream(payload)
    s = mpeg_audio.read_stream(data)
    junk = data[: s.offsets[3]] + b"\xff\xfb\x00junk\xff\xff" + data[s.offsets[3] :]
    again = mpeg_audio.read_stream(junk)
    assert len(again.offsets) == 10 and again.resyncs == 1 and again.skipped == 9
    broken = bytearray(data)
    broken[s.offsets[2] + 7] ^= 1  # in the side information, which the checksum covers
    assert mpeg_audio.read_stream(bytes(broken)).crc_good == 9
    cut = mpeg_audio.read_stream(data[: s.offsets[-1] + 10])
    assert len(cut.offsets) == 9 and cut.skipped == 10


def test_mpeg_crc_against_division():
    def plain(data):
        value = int.from_bytes(data) << 16
        value ^= 0xFFFF << (len(data) * 8)
        for bit in range(len(data) * 8 + 15, 15, -1):
            if value >> bit & 1:
                value ^= 0x18005 << (bit - 16)
        return value

    for data in (b"\x50\x04" + bytes(17), b"abc", bytes(range(40))):
        assert mpeg_audio.crc16(data) == plain(data)


def test_mpeg_other_layers_vbri_and_tags():
    layer1 = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 3 << 17 | 1 << 16 | 5 << 12 | 1 << 10 | 3 << 6)
    h = mpeg_audio.parse_header(int.from_bytes(layer1))
    assert (h.layer, h.samples, h.kbps, h.size) == (1, 384, 160, 160)
    assert mpeg_audio.parse_header(0) is None and mpeg_audio.parse_header(0xFFFFFFFF) is None
    frame3 = mpeg_audio._header(6, False).ljust(240, b"\0")
    vbri = bytearray(frame3)
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 960, 3, 2, 1, 2, 1)
    s = mpeg_audio.read_stream(b"ID3\x03\0\0\0\0\0\x15TIT2\0\0\0\x05\0\0\0name......" + bytes(vbri) + frame3 * 3)
    assert s.table == "VBRI" and s.table_frames == 3 and len(s.offsets) == 3 and s.tags["TIT2"] == "name"
    assert mpeg_audio.describe(None)["n_frames"] == 0 and mpeg_audio.describe(b"no audio at all")["skipped_bytes"] == 15


def test_mpeg_query_rows(spark):
    out = {r.doc_id: r for r in mpeg_audio.read_media(mpeg_audio.store_text(clashing(frame(spark, HARD)))).collect()}
    assert len(out) == len(HARD)
    for k, text in enumerate(HARD):
        payload = mpeg_audio.padded(text)
        r = out[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert out[HARD.index("same")].media_sha256 == out[HARD.index("same") + 1].media_sha256


# --- 2 lines


def brute_lines(texts, least_docs=2, least_run=20):
    """By definition, with templates compared as such and runs found by looking at every range of units."""
    import re

    def cut(text):
        return re.split(r"((?<=[.!?]) |\n)", text or "")

    def shape(unit):
        w = re.findall(r"[^\x20\x09-\x0D]+", unit)
        if len(w) < 4:
            return set()
        w = ["<*>" if re.search("[0-9]", x) else x for x in w]
        if len(w) - 2 < 12:
            return {(len(w), 0, tuple(w))}
        half = 2 + (len(w) - 2) // 2
        return {(len(w), 1, tuple(w[:half])), (len(w), 2, tuple(w[:2] + w[half:]))}

    blank = " \t\n\r\x0b\x0c"
    count = lambda unit: len(re.findall(r"[^\x20\x09-\x0D]+", unit))

    def pairs(text):
        """Neighbours of which one is short, in series of short units that are over 8 words or 64 bytes long."""
        filled = [u for u in cut(text)[::2] if count(u)]
        out, k = set(), 0
        while k < len(filled):
            end = k
            while end < len(filled) and count(filled[end]) < 4:
                end += 1
            if sum(map(count, filled[k:end])) > 8 or sum(len(u.encode()) for u in filled[k:end]) > 64:
                near = [u.strip(blank) for u in filled[max(k - 1, 0) : end + 1]]
                out |= set(zip(near, near[1:], strict=False))
            k = end + 1
        return out

    owners, beside = {}, {}
    for d, text in texts:
        for unit in cut(text)[::2]:
            for t in shape(unit):
                owners.setdefault(t, set()).add(d)
        for pair in pairs(text):
            beside.setdefault(pair, set()).add(d)
    out = []
    for d, text in texts:
        parts = [*cut(text), ""]
        n = len(parts) // 2
        units = parts[::2]
        words = list(map(count, units))
        bad = [any(len(owners[t]) >= least_docs and min(owners[t]) != d for t in shape(p)) for p in units]
        recurs = lambda a, b: d in (who := beside.get((units[a].strip(blank), units[b].strip(blank)), ())) and len(who) >= least_docs and min(who) != d  # noqa: B023, E731
        filled = [k for k in range(n) if words[k]]
        place = {k: i for i, k in enumerate(filled)}

        def own(k):
            """A short unit that doesn't recur with a neighbour."""
            i = place.get(k)  # noqa: B023
            return i is not None and not any(0 <= j and j + 1 < len(filled) and recurs(filled[j], filled[j + 1]) for j in (i - 1, i))  # noqa: B023

        at = [k for k in range(n) if bad[k]]
        gone = [False] * n
        while at:
            run = [at.pop(0)]
            while at:
                gap = range(run[-1] + 1, at[0])
                mine = [units[k].strip(blank) for k in gap if own(k)]
                if any(words[k] >= 4 for k in gap) or sum(map(count, mine)) > 8 or sum(len(u.encode()) for u in mine) > 64:
                    break
                run.append(at.pop(0))
            a, b = run[0], run[-1] + 1
            lines = not "".join(parts[: 2 * a]).rpartition("\n")[2].strip(blank) and not "".join(parts[2 * b - 1 :]).partition("\n")[0].strip(blank)
            if sum(words[a:b]) >= least_run or lines:
                gone[a:b] = [True] * (b - a)
        out.append((d, [p for p, g in zip(units, gone, strict=True) if p.strip() and not g], sum(gone)))
    return out


def test_line_templates_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["the", "of", "red", "blue", "7", "x1", "sea", "é"]) for _ in range(rng.randrange(1, 22))) + rng.choice([".", "!", ""]) for _ in range(40)]
    texts = [(k, "".join(rng.choice(pool) + rng.choice([" ", "\n", " ", "\n\n"]) for _ in range(rng.randrange(0, 8)))) for k in range(80)] + [(100 + k, t) for k, t in enumerate(HARD)]
    for least in (2, 3):
        df = clashing(frame(spark, [t for _, t in texts], [d for d, _ in texts]))
        got = {r.doc_id: r for r in line_templates.drop_templates(df, least_docs=least).collect()}
        old = dict(texts)
        for d, kept, n_gone in brute_lines(texts, least):
            if not n_gone:
                assert got[d].text == old[d] and got[d].n_dropped == 0
            else:
                assert got[d].n_dropped == n_gone and [u.decode() for u in line_templates.units(got[d].text)[::2] if u.strip()] == kept


def test_heavy_templates_are_dealt_to_many_tasks(spark):
    n = 3000
    keys = spark.range(n).select(F.col("id"), (F.col("id") * 7).alias("unit"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50 + 100).cast("long").alias("key"))
    found = line_templates.recurring(keys)
    plain = {(r.id, r.unit) for r in line_templates.met_keys(keys, found, heavy=10**9).collect()}
    salted = line_templates.met_keys(keys, found, heavy=100)
    assert {(r.id, r.unit) for r in salted.collect()} == plain and len(plain) == n - 51
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in line_templates.met_keys(keys, found, heavy=100).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < n / 10 and len(sizes) > 30
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_templates_generalise():
    t = line_templates.templates
    a, b = b"Order 17 was sent by Ann to the house at noon in a box of wood", b"Order 934 was sent by Bob to the house at noon in a box of wood"
    assert set(t(a)) & set(t(b))
    assert not set(t(a)) & set(t(b"Order 17 was brought by Ann to her flat at night in a bag of wool"))
    assert not set(t(a)) & set(t(a + b" today"))
    assert t(b"too short now") == []
    for text in ("A b. C d!  e\n\nf", "x. \ny.z? ! ", *filter(None, HARD)):
        assert b"".join(line_templates.units(text)) == text.encode() and set(line_templates.units(text)[::2]) == line_templates.distinct_units(text.encode())


def test_repeated_passages_stay_once(spark):
    passage = " ".join(f"Word{chr(97 + k % 26)} goes {chr(97 + k // 26)} and on{'.' if k % 3 else '!'}" for k in range(14))
    docs = [f"First of all here {w} things are told. {passage} And then {w} comes the end of it.\nAnother line of {w} here." for w in ("alpha", "beta", "gamma")]
    out = {r.doc_id: r for r in line_templates.drop_templates(frame(spark, [*docs, "First of all here alpha things are told. Not so."]), length_col="n_chars").collect()}
    assert out[0].text == docs[0] and out[3].text.endswith("Not so.") and out[3].n_dropped == 0
    for d, w in ((1, "beta"), (2, "gamma")):
        assert out[d].text == docs[d].replace(passage + " ", "") and out[d].n_chars == len(out[d].text) and out[d].n_dropped == 14, w


def test_own_short_lines_stay(spark):
    head, foot = "This page was made by the club", "All rights are kept"
    own = [f"item {chr(97 + k % 26)}{k}" for k in range(60)]
    script = ["\u4e00\u4e8c\u4e09" * 12 + chr(0x4E00 + k) for k in range(20)]
    chant = [f"sing {w}" for w in "abcdefghijkl"]
    docs = ["\n".join([head, *body, foot]) for body in (["Some other line that stands here"], own, script, chant, chant, ["1", "2"])]
    got = {r.doc_id: r.text for r in line_templates.drop_templates(frame(spark, docs)).collect()}
    assert got[0] == docs[0] and got[1].split("\n") == own and got[2].split("\n") == script
    assert got[3].split("\n") == chant and got[4] == "" and got[5] == ""


# --- 3 decontamination


def brute_hits(items, doc, window):
    dw = decontaminate.words(doc)
    hit, found = [False] * len(dw), set()
    for k, (_, text) in enumerate(items):
        iw = decontaminate.words(text)
        size = min(window, len(iw))
        for w in {tuple(iw[j : j + size]) for j in range(len(iw) - size + 1)} if iw else ():
            for p in range(len(dw) - size + 1):
                if tuple(dw[p : p + size]) == w:
                    found.add(k)
                    hit[p : p + size] = [True] * size
    return hit, found


def test_automaton_against_brute_force():
    for seed in range(1500):
        rng = random.Random(seed)
        letters = rng.choice(["ab", "abc", "abcdef"])
        items = [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(10)))) for k in range(rng.randrange(6))]
        doc = " ".join(rng.choice(letters + "z") for _ in range(rng.randrange(50)))
        window = rng.choice([1, 2, 3, 4])
        hit, found = decontaminate.Automaton(items, window).scan(decontaminate.words(doc))
        assert (hit.tolist(), found) == brute_hits(items, doc, window)


def test_match_in_blocks_equals_one_pass(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(12))) for k in range(9)] + [(20, None), (21, "b c"), (22, "")]
    docs = [" ".join(rng.choice("abcde") for _ in range(80)) for _ in range(30)] + HARD
    df, bench = clashing(frame(spark, docs)), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda out: sorted(map(tuple, decontaminate.digest(out).collect()))
    one = rows(decontaminate.match_items(df, bench))
    assert one == rows(decontaminate.match_items(df, bench, block_words=25))
    expected = []
    for d, text in enumerate(docs):
        hit, found = brute_hits(items, text, 8)
        ids = ",".join(sorted(str(items[k][0]) for k in found))
        expected.append((d, len(hit), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2))
    assert one == sorted(expected)


def test_repeated_items_count_once(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(5, item), (5, item), (12, "a b c d e f g h i")], "item_id long, text string")
    docs = frame(spark, [f"so {item} it is", f"{item} a b c d e f g h", "none of it"])
    for block_words in (10, 200_000):
        got = {r.doc_id: (r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(decontaminate.match_items(docs, bench, block_words=block_words)).collect()}
        assert got == {k: (n, hashlib.sha256(ids.encode()).hexdigest(), n >= 2) for k, (n, ids) in enumerate([(1, "5"), (2, "12,5"), (0, "")])}


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [f"Before it all we had much to say here and there. {item.upper()}! After it we said even more than before.", item, "clean text", None]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.remove_items(frame(spark, docs), bench, length_col="n_chars").collect()}
    assert set(out) == {0, 2, 3} and "FOUR" not in out[0].text and out[0].text.startswith("Before") and out[0].text.endswith("than before.") and out[0].n_chars == len(out[0].text)
    assert out[2].text == "clean text" and out[3].text is None
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_items(frame(spark, docs), empty).count() == 4


def test_removal_in_blocks_equals_one_pass(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("bcdfgh") + str(rng.randrange(500)) for _ in range(n))
    a, b = say(30), say(30)
    tied = [f"{a[: a.rindex(' ')]} {b}", a]  # windows of both items overlap
    items = [(1, a), (2, b), (3, " ".join(tied[0].split()[20:40])), (4, None)] + [(k, " ".join(rng.choice("abcd") for _ in range(12))) for k in range(5, 14)]
    docs = [f"{say(20)} {a} {say(10)} {b} {say(10)}", f"{say(40)} {a}. {b} {say(80)}", f"{say(60)} {tied[0]} {say(60)}", a, None, "", f"{say(70)} {a[:60]} {b} {a[60:]} {say(70)}"]
    docs += [f"{say(40)} {' '.join(rng.choice('abcde') for _ in range(60))}. {say(40)}" for _ in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda n: sorted(map(str, decontaminate.remove_items(clashing(frame(spark, docs)), bench, length_col="n_chars", block_words=n).collect()))
    one = rows(200_000)
    assert not any("doc_id=0," in r or "doc_id=3," in r for r in one) and len(one) < len(docs)
    assert rows(25) == one
    assert rows(40) == one


# --- 4 token counts, 5 and 10 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


SAMPLE = [*HARD[:8], "The and attion\n\nto thanedble  the,   anea.\n", "Ñado 12,5 % l'eau — “quoted” naïve text\r\n\tx", "don't I'll <|endoftext|> 3.14", "x" * 3000 + "\n" + "word and more " * 900]


def test_ids_are_the_tokenizers(tokenizer):
    for text in SAMPLE:
        assert encode(ranks_path(), text or "") == tokenizer.encode(text or "", add_special_tokens=False).ids


def brute_sections(tokenizer, text, rule):
    spans = token_attribution.lines(text)
    enc = tokenizer.encode(text, add_special_tokens=False)
    at = 0
    counts = [0] * len(spans)
    raw = text.encode()
    bounds = [(len(text[:a].encode()), len(text[:b].encode())) for _, a, b in spans]
    for token in enc.ids:
        size = len(encode_bytes(token))
        inside = [max(0, min(at + size, b) - max(at, a)) for a, b in bounds]
        touched = [k for k, n in enumerate(inside) if n]
        counts[touched[0] if rule == "start" else touched[-1] if rule == "end" else max(touched, key=lambda k: (inside[k], -k))] += 1
        at += size
    assert at == len(raw)
    return counts


def encode_bytes(token):
    from ridgeline.llm.common import byte_bpe

    return byte_bpe(ranks_path()).decode_single_token_bytes(token)


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_sections_against_brute_force(spark, tokenizer, rule):
    rows = token_attribution.section_tokens(clashing(frame(spark, SAMPLE)), ranks_path(), rule=rule).collect()
    for d, text in enumerate(SAMPLE):
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.section)
        assert [r.n_tokens for r in own] == brute_sections(tokenizer, text or "", rule)
        assert sum(r.n_tokens for r in own) == own[0].doc_tokens and "".join((text or "")[r.start : r.end] for r in own) == (text or "")


def test_fields_tile():
    text, spans = token_attribution.fields({"title": "A b", "body": "c\nd"})
    assert text == "A b\nc\nd\n" and [(n, text[a:b]) for n, a, b in spans] == [("title", "A b\n"), ("body", "c\nd\n")]


def test_nnls_against_optimality():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.normal(size=(12, 20)), rng.normal(size=12)
        x = nnls_packing.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-5).all() and abs(slope @ x) < 1e-4


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(1)
    for units in (8, 64, 256):
        histogram = {int(s): int(n) for s, n in zip(*np.unique(rng.integers(1, units, 400), return_counts=True), strict=True)}
        plan = nnls_packing.solve(histogram, units)
        used = {}
        for fill, repeats in plan:
            assert sum(fill) <= units and repeats > 0
            for s in fill:
                used[s] = used.get(s, 0) + repeats
        assert used == histogram


def test_packing_is_whole(spark, tokenizer):
    texts = SAMPLE * 12
    rows = nnls_packing.pack(clashing(frame(spark, texts)), ranks_path()).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    waste = nnls_packing.padding(nnls_packing.pack(frame(spark, texts), ranks_path())).first()
    assert waste.tokens == sum(map(len, ids)) and waste.sequences == len(by_sequence)


def test_best_fit_decreasing_against_plain_search():
    for seed in range(60):
        lengths = np.random.default_rng(seed).integers(1, 65, 80)
        rooms = []
        for size in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(64 - size)
        rows = bfd_packing.best_fit_decreasing(lengths, 64)
        assert sorted(64 - int(lengths[r].sum()) for r in rows) == sorted(rooms) and sorted(k for r in rows for k in r) == list(range(80))


@pytest.mark.parametrize("block", [500, 4_000_000])
def test_matrices_unpack(spark, tokenizer, block, tmp_path):
    packed = bfd_packing.pack(clashing(frame(spark, SAMPLE)), ranks_path(), block=block)
    bfd_packing.write_matrices(packed, str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    for r in stored.collect():
        assert len(r.ids) == 4096 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used <= 2048 and r.position_resets == r.cu_seqlens[:-1]
    whole = {}
    for r in stored.transform(bfd_packing.unpack).collect():
        whole.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for d, text in enumerate(SAMPLE):
        assert np.frombuffer(b"".join(x for _, x in sorted(whole[d])), dtype="<u2").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


# --- 6 classifier


def test_network_slopes():
    rng = np.random.default_rng(0)
    model = byte_cnn.Model(rng.normal(size=(256, byte_cnn.VECTOR)), rng.normal(size=(byte_cnn.WIDTH, byte_cnn.VECTOR, byte_cnn.FILTERS)), rng.normal(size=(3, byte_cnn.FILTERS)) * 0.1, 0.1)
    texts = ["some words here " * 90, "", "è" * 700, "A! " * 20]
    y = np.array([1.0, 0, 1, 0])

    def loss():
        p = byte_cnn.score(model, model.tables(), texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes = byte_cnn.gradient(model, [t.encode() for t in texts], y, np.ones(4))
    for name, at in (("weights", (1, 3)), ("weights", (2, 5)), ("weights", (0, 0)), ("filters", (2, 3, 4)), ("vectors", (101, 2))):
        values, step = getattr(model, name), 1e-3
        old = values[at]
        values[at] = old + step
        up = loss()
        values[at] = old - step
        down = loss()
        values[at] = old
        assert abs((up - down) / 2 / step - slopes[name][at]) < 2e-3 * max(1, abs(slopes[name][at]))


def test_scores_cover_the_whole_document_alone():
    rng = np.random.default_rng(2)
    model = byte_cnn.Model(rng.normal(size=(256, byte_cnn.VECTOR)), rng.normal(size=(byte_cnn.WIDTH, byte_cnn.VECTOR, byte_cnn.FILTERS)), rng.normal(size=(3, byte_cnn.FILTERS)) * 0.01, 0.0)
    texts = [None, "", "a", "b" * 504, "c" * 505, "d" * 5000, "e" * 100_000 + "Z!", "e" * 100_000]
    together = byte_cnn.score(model, model.tables(), texts)
    alone = np.array([byte_cnn.score(model, model.tables(), [t])[0] for t in texts])
    assert np.allclose(together, alone) and together[0] == together[1] and together[-1] != together[-2] and ((0 <= together) & (together <= 1)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = byte_cnn.fit(docs, labels)
    scored = byte_cnn.with_score(docs, model, columns=["doc_id"]).join(labels, "doc_id").where(byte_cnn.held_out()).toPandas()
    assert len(scored) > 100 and ((scored.score >= 0.5) == scored.quality).mean() > 0.93


def test_classifier_without_labels(spark):
    docs, none = frame(spark, HARD), spark.createDataFrame([], "doc_id long, quality int")
    assert byte_cnn.keep_good(docs, none).count() == len(HARD)
    bad = spark.createDataFrame([(0, 0), (1, None)], "doc_id long, quality int")
    model = byte_cnn.fit(docs, bad)
    assert {r.score for r in byte_cnn.with_score(clashing(docs), model).collect()} == {0.0}


# --- 7 secrets


def test_base_spans_against_plain_patterns():
    import re

    rng = random.Random(9)
    pieces = ["password=", "PassWd : '", "secret", "api_key=", "apikey:\"", "token = ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "deadbeef", "==", "é", " ", "\n", "x", "password=token: ", "ſecret=abcdefghij", "toKen=abcdefghij"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        expected = [(m.start(), m.end(), "assign") for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
        expected += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        expected += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        assert secret_scan.base_spans(text) == sorted(expected, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


def brute_guess_cost(value, words):
    """All cuts, each part at its least cost by rules of its own here."""
    import math
    import re
    from functools import cache

    keys = {c: (x + y / 2, y) for y, row in enumerate(("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")) for x, c in enumerate(row)}
    near = lambda a, b: a in keys and b in keys and a != b and abs(keys[a][0] - keys[b][0]) <= 1 and abs(keys[a][1] - keys[b][1]) <= 1
    leet = dict(zip("4@831!0$57+", "aabeiiosstt", strict=True))
    months, days = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12][0-9]|3[01])"
    dates = [f"(19|20)[0-9][0-9]{sep}{months}{sep}{days}|{days}{sep}{months}{sep}(19|20)[0-9][0-9]" for sep in ("", "-", "/", "[.]", "_")]

    def part(own):
        n, low = len(own), own.lower()
        yield n * 1.0
        for form, twist in ((low, 0.0), ("".join(leet.get(c, c) for c in low), 0.6)):
            if form in words:
                yield math.log10(words.index(form) + 2) + twist + (0.0 if own == low else 0.3 if own.istitle() or own.isupper() else 1.0)
                break
        if re.fullmatch("(19|20)[0-9][0-9]", own):
            yield 2.1
        if any(re.fullmatch(d, own) for d in dates):
            yield 4.6
        for unit in range(1, n // 2 + 1):
            if n % unit == 0 and own[:unit] * (n // unit) == own:
                yield unit + math.log10(2) * math.ceil(math.log2(n // unit))
        if n >= 3 and all(near(a, b) for a, b in zip(low, low[1:], strict=False)):
            yield math.log10(47) + 0.35 * n
        if n >= 3 and low.isascii() and low.isalnum() and any(all(ord(b) - ord(a) == d for a, b in zip(low, low[1:], strict=False)) for d in (1, -1)):
            yield 1.2 + math.log10(n)

    @cache
    def best(k):
        return 0.0 if k == len(value) else min(0.3 + min(part(value[k:j])) + best(j) for j in range(k + 1, len(value) + 1))

    return best(0)


def test_guess_cost_is_the_cheapest_cut():
    words = list(secret_scan.WORDS)
    rng = random.Random(8)
    pieces = ["password", "Dragon", "asdf", "qwe", "12", "3", "aa", "abab", "xyz", "2019", "2019-05-04", "19", "P4ss", "@", "é", "zz", "k9", "cba", "1", "a", "q", "w"]
    values = ["password", "pass12", "aaaa19", "qwer1", "x9", "20190504a", "abcdx", "asdfdragon", "qwerty123", "aaaaaaaab", "abcabcabcabcx", "1a1a1a2b2b", "İx9", "12345678901", "a" * 37, "xy" * 21 + "x"]
    values += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    for value in values:
        cost, cut = secret_scan.guess_cost(value)
        if value.lower() == secret_scan.lowered(value):
            assert abs(cost - brute_guess_cost(value, words)) < 1e-9, (value, cut)
        assert "".join(c for _, c in cut) == value
    weak, strong = (secret_scan.guess_cost(v)[0] for v in ("password123", "b7db7aa4a5fcc78305"))
    assert weak < secret_scan.LEAST_GUESSES < strong


def test_guess_cost_has_no_length_switch():
    unit = "k3x9zQ7w" * 2 + "p5Lr8TmV2bNc4HdF6gJs1y0u"
    short, long = (secret_scan.guess_cost(unit * n)[0] for n in (100, 104))  # 4,000 and 4,160 characters
    assert long - short < 1
    assert secret_scan.guess_cost("aB3$" * 20_000)[0] < 12 and len(secret_scan.guess_cost("x" * 60_000)[1]) == 1


def test_credential_contexts():
    found = lambda text: [text[a:b] for a, b, _ in secret_scan.guess_spans(text)]
    assert found("Authorization: Bearer eyJhbGciOi9x7Kq.zz3") == ["eyJhbGciOi9x7Kq.zz3"]
    assert found("auth: token q8Zx71kPw2Lm") == ["q8Zx71kPw2Lm"] and found("token:" + " " * 90 + "q8Zx71kPw2Lm") == ["q8Zx71kPw2Lm"]
    assert found("the token generation is unremarkable") == [] and found("password is 'Zq8! vR2#kL'") == ["Zq8! vR2#kL"] and found("pwd=q1") == []


def test_most_counted(spark):
    from ridgeline.llm.common import most_counted

    rows = [(f"w{k}", n) for k, n in enumerate([100, 3, 3, 3, 50, 51, 7, 7, 1])]
    df = spark.createDataFrame(rows, "value string, n long")
    assert most_counted(df, 100) == [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert most_counted(df, 5) == ["w0", "w5", "w4", "w6", "w7"] == most_counted(df, 7) and most_counted(df, 2) == ["w0"] and most_counted(df, 0) == []
    assert most_counted(df.where("false"), 5) == []


def test_corpus_words(spark):
    docs = frame(spark, ["zebra Zebra apple", "zebra kiwi x9x", "zebra apple", "apple it", None, ""])
    assert secret_scan.corpus_words(docs) == ["apple", "zebra"]
    said = frame(spark, ["pwd: zebraapple"] * 3)
    assert [len(r.secrets) for r in secret_scan.scan(said, words=()).collect()] == [1, 1, 1]
    assert [len(r.secrets) for r in secret_scan.scan(said, words=("apple", "zebra")).collect()] == [0, 0, 0]


def test_secret_rows(spark):
    texts = [*HARD, "my pwd is 'Zq8!vR2#kL' ok", "pwd: password", "password=b7db7aa4a5fcc78305 x"]
    rows = {r.doc_id: r for r in secret_scan.scan(clashing(frame(spark, texts))).collect()}
    n = len(HARD)
    assert [tuple(s) for s in rows[n].secrets] == [(11, 21, "guess")] and rows[n + 1].secrets == [] and {s.kind for s in rows[n + 2].secrets} == {"assign", "guess"}
    assert all(r.base == [] for k, r in rows.items() if k < n)
    assert secret_scan.redact("a secret b", [(2, 8)]) == "a [secret] b"


# --- 8 near duplicates


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    rng = random.Random(2)
    for text in [*HARD, *(" ".join(rng.choice("abcDE") for _ in range(rng.randrange(40))) for _ in range(200))]:
        assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    assert simhash_dedup.fingerprint("a b c") == spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64)


def brute_components(fps, ids, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(fps))]


def clustered(rng, n):
    """Fingerprints in chains: each of half of them is a few flipped bits away from another."""
    fps = []
    for _ in range(n):
        fp = rng.choice(fps) if fps and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    return fps


PLANS = {
    "four": [simhash_dedup.Part(tuple(range(16 * k, 16 * k + 16)), 0) for k in range(4)],
    "two": [simhash_dedup.Part(tuple(range(32)), 1), simhash_dedup.Part(tuple(range(32, 64)), 1)],
    "uneven": [simhash_dedup.Part(tuple(range(0, 30)), 1), simhash_dedup.Part(tuple(range(30, 47)), 0), simhash_dedup.Part(tuple(range(47, 64)), 0)],
}


@pytest.mark.parametrize("name", PLANS)
@pytest.mark.parametrize("block", [5, 4096])
def test_links_against_brute_force(spark, name, block):
    fps = sorted(set(clustered(random.Random(hash(name) % 100), 300)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, s) for s in signed], "fp long, node long")
    links = simhash_dedup.near_links(nodes, PLANS[name], block=block)
    roots = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert [roots.get(s, s) for s in signed] == brute_components(fps, signed)


def test_large_groups_are_searched_breadth_first():
    rng = np.random.default_rng(0)
    fps = np.array(clustered(random.Random(4), 400), dtype=np.uint64)
    group = np.sort(rng.integers(0, 3, 400))
    for left in (np.zeros(400, dtype=int), rng.choice([-1, 1], 400)):
        forest = simhash_dedup.Forest()
        simhash_dedup.link_sorted(group, fps, np.arange(400), left, 3, forest)
        plain = simhash_dedup.Forest()
        for a in range(400):
            for b in range(a):
                if group[a] == group[b] and bin(int(fps[a]) ^ int(fps[b])).count("1") <= 3 and (left[a] == 0 or left[a] != left[b]):
                    plain.join(a, b)
        assert [forest.root(k) for k in range(400)] == [plain.root(k) for k in range(400)]


def test_plan_gives_out_the_radius():
    for n in (10, 10_000, 10**7, 10**10):
        bits = np.random.default_rng(0).random((500, 64)) < 0.5
        both = bits.T.astype(float) @ bits * (n / 500)
        parts = simhash_dedup.plan(n, both)
        assert sum(p.threshold + 1 for p in parts) == 4 and all(p.threshold >= 0 for p in parts)
        used = [b for p in parts for b in p.bits]
        assert len(used) == len(set(used))


def test_near_duplicates_of_documents(spark):
    rng = random.Random(6)
    base = " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe", "ra"]) + str(rng.randrange(99)) for _ in range(300))
    texts = [*HARD, base, base + " end", base.upper(), base, base.replace("ka", "KA", 1)]
    ids = list(range(50, 50 + len(texts)))
    rows = simhash_dedup.near_duplicates(clashing(frame(spark, texts, ids))).collect()
    fps = [brute_fingerprint(t) for t in texts]
    expected = brute_components(fps, ids)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, expected, strict=True))
    kept = simhash_dedup.keep_first(frame(spark, texts, ids))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def test_keep_first_tells_rows_apart(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"{rng.choice('bcdfg')}{rng.randrange(999)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, e), (7, e), (None, e)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA).repartition(3)
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash_dedup.keep_first(docs).collect()))
    assert kept == sorted([(0, a), (0, b), (7, c), (7, d), (7, e)])


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(11)
    words = [rng.choice("bcdfglmn") + str(k) for k in range(400)]
    texts = [None, "", "one two", "One  two", "one two three", *HARD]
    for _ in range(50):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 250))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 15)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.choice((0, 1, 1, 2))] = [rng.choice(words)]
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
        assert len(simhash_dedup.shingle_set(t)) == len(sets[-1])
    fps, n = [brute_fingerprint(t) for t in texts], len(texts)
    root, far = list(range(n)), 0
    for a in range(n):
        for b in range(a):
            similar = bool(sets[a] and sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            if similar or bin(fps[a] ^ fps[b]).count("1") <= 3:
                far += bin(fps[a] ^ fps[b]).count("1") > 3
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert far > 20
    kept = simhash_dedup.keep_first(frame(spark, texts), similarity=simhash_dedup.SIMILARITY)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    signed = simhash_dedup.signatures(frame(spark, texts), "doc_id", "text", "doc_id", 3, 0.8, simhash_dedup.common_hashes(frame(spark, texts).selectExpr("doc_id AS row", "text")))
    signed = simhash_dedup.shared_hashes(signed).selectExpr("*", "sig AS root").cache()
    whole = {tuple(r) for r in simhash_dedup.similar_candidates(signed, 0.8, False).collect()}
    assert whole == {tuple(r) for r in simhash_dedup.similar_candidates(signed, 0.8, False, block=2).collect()} != set()


def test_chains_and_stars(spark):
    chain = [(k + 1, k) for k in range(60)]
    star = [(1000 + k, 999) for k in range(200)]
    loop = [(5000, 5001), (5001, 5002), (5002, 5000), (5000, 5000)]
    roots = {r.node: r.root for r in simhash_dedup.components(spark.createDataFrame(chain + star + loop, "a long, b long")).collect()}
    assert all(roots[k] == 0 for k in range(1, 61)) and all(roots[1000 + k] == 999 for k in range(200)) and roots[5001] == roots[5002] == 5000


# --- 9 chat


def test_escaping_is_reversible():
    rng = random.Random(8)
    pieces = [*chat_format.CONTROL, "\\", "\n", "a", "<", "|", "im_start|>", "[", "INST]", "</"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROL)
        role = "".join(rng.choice(["\n", "\\", "r", "<s>"]) for _ in range(rng.randrange(5)))
        assert chat_format.parse_turn(chat_format.chatml([(chat_format.escape_role(role), safe)])) == (role, text)


def test_rewriting_templates_are_found():
    def forgetful(messages):
        return "".join(f"<{r}>{'' if r == 'think' and k < len(messages) - 1 else t}</{r}>" for k, (r, t) in enumerate(messages))

    def loud(messages):
        return "".join(f"{r}:{t.upper()};" for r, t in messages)

    r = chat_format.Renderer(forgetful)
    seen = [(r.add(*m)[0], r.rewrites) for m in (("user", "hi"), ("think", "hmm"), ("assistant", "yes"))]
    assert [x for _, x in seen] == [False, False, True]
    r = chat_format.Renderer(loud)
    assert r.add("user", "abc")[4] is False and r.add("user", "ABC")[4] is True


def forget(messages):
    """Blanks all thoughts but the last turn's."""
    return "".join(f"<{r}>{'' if r == 'think' and k < len(messages) - 1 else t}</{r}>" for k, (r, t) in enumerate(messages))


def test_spans_of_rewriting_templates(spark):
    said = [("user", "hi"), ("think", "hmm hmm"), ("assistant", "yes"), ("user", "more"), ("think", "x"), ("assistant", "no")]
    rows = chat_format.final_spans(chat_format.format_turns(spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string"), template=forget)).orderBy("position").collect()
    whole = forget(said)
    assert rows[-1].end == len(whole) and [r.holds for r in rows] == [True, False, True, True, False, True]
    out = ""
    for r in rows:  # each span replaces what stood from its start on
        out = out[: r.start] + r.segment
        assert out == forget(said[: r.position + 1])
        if r.holds:
            assert whole[r.start : r.end] == r.segment
        if r.holds and not r.altered:
            assert whole[r.text_start : r.text_end] == said[r.position][1] or r.rewrites
    assert chat_format.digest(chat_format.format_turns(spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string"), template=forget), read=lambda s: ("", s)).first().formatted_chars == len(whole)


def test_long_conversations_are_rendered_whole(spark):
    def numbered(messages):
        return "".join(f"[{k}:{r}]{t}\n" for k, (r, t) in enumerate(messages))

    def late(messages):
        return "".join(f"<{r}>{'' if k < len(messages) - 70 else t}" for k, (r, t) in enumerate(messages))

    said = [("user", f"turn {k}") for k in range(90)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows = chat_format.format_turns(df, template=numbered).orderBy("position").collect()
    assert "".join(r.segment for r in rows) == numbered(said) and not any(r.rewrites for r in rows)
    rows = chat_format.format_turns(df, template=late).orderBy("position").collect()
    assert [r.rewrites for r in rows] == [False] * 70 + [True] * 20 and rows[-1].end == len(late(said))


def test_a_stated_look_back_gives_the_same():
    def pairs(messages):
        return "<s>" + "".join(f"{r}>{t};" if not k or messages[k - 1][0] != r else f"+{t};" for k, (r, t) in enumerate(messages))

    rng = random.Random(3)
    said = [(rng.choice("ab"), "x" * rng.randrange(4)) for _ in range(30)]
    full, short = chat_format.Renderer(pairs), chat_format.Renderer(pairs, looks_back=1)
    assert [full.add(*m) for m in said][1:] == [short.add(*m) for m in said][1:] and not short.rewrites


def test_the_query_renders_whole_prefixes(spark, tmp_path, monkeypatch):
    def late(messages):
        """chatml, but from the 81st turn on the first turn's text is turned round."""
        return chat_format.chatml([(r, t[::-1] if not k and len(messages) > 80 else t) for k, (r, t) in enumerate(messages)])

    late.__dict__.update(vars(chat_format.chatml))  # it states what the query's own template states
    said = {c: [("user" if k % 2 else "assistant", f"turn {k}") for k in range(n)] for c, n in ((1, 80), (2, 81), (3, 90))}
    spark.createDataFrame([(c, k, r, t) for c in said for k, (r, t) in enumerate(said[c])], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(chat_format, "format_turns", functools.partial(chat_format.format_turns, template=late))
    got = {r.conv_id: r for r in llm_queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert {c: r.rewrites for c, r in got.items()} == {-1: False, 1: False, 2: True, 3: True}
    assert [got[c].formatted_chars for c in said] == [len(late(said[c])) for c in said]


def test_digest_refuses_dealt_turns(spark):
    df = spark.createDataFrame([(c, k, "user", "t") for c in range(3) for k in range(5)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="out of order"):
        chat_format.digest(chat_format.format_turns(df).orderBy(F.desc("position"))).collect()


def test_broken_vbr_tables_are_none():
    short = struct.pack(">I", 0x7FF << 21 | 2 << 19 | 1 << 17 | 1 << 16 | 1 << 12 | 0 << 10 | 3 << 6)  # MPEG-2 layer III, 8 kbit/s
    size = mpeg_audio.parse_header(int.from_bytes(short)).size
    for tail in (b"VBRI", b"VBRI" + bytes(10), b"VBRI" + b"\xff" * 22):
        frame2 = (short + bytes(32) + tail).ljust(size, b"\0")[:size]
        s = mpeg_audio.read_stream(frame2)
        assert (s.table, len(s.offsets)) == ("", 1)
    data = mpeg_audio.write_stream(bytes(range(1, 193)) * 3)
    assert mpeg_audio.describe(data)["seek_offsets"] == mpeg_audio.read_stream(data).offsets and len(mpeg_audio.describe(data)["seek_offsets"]) == 3
    assert mpeg_audio.read_payload(data[:600], mpeg_audio.read_stream(data[:600])) in (b"", bytes(range(1, 193)))


def test_map_columns_and_clashing_names(spark):
    docs = clashing(frame(spark, ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", None, "x"])).withColumns({"m": F.create_map(F.lit("k"), F.lit(1)), "_row": F.lit(1), "_ranges": F.lit(2), "row": F.lit(3), "_changed": F.lit(4)})
    bench = spark.createDataFrame([(1, "three four five"), (2, "nine ten")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out, n in ((simhash_dedup.keep_first(docs, similarity=0.8), 3), (simhash_dedup.keep_first(docs), 3), (decontaminate.remove_items(docs, bench), 4), (decontaminate.remove_items(docs, bench, block_words=3), 4), (byte_cnn.keep_good(docs, labels), 4), (line_templates.drop_templates(docs), 4)):
        assert set(docs.columns) - {"n_lines", "n_dropped"} <= set(out.columns) and out.count() == n and all(r.m == {"k": 1} for r in out.collect())


def test_conversations_read_back(spark):
    rng = random.Random(1)
    texts = [*HARD[:8], "<|im_end|>", "assistant", "user\n", "\\", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole\\"]), rng.choice(texts)) for c in range(20) for t in range(rng.randrange(1, 9))] + [(5, 1, "user", "same turn"), (5, 1, "user", "same turn"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("position", "segment", "c", "t", "start")})
    turns = chat_format.format_turns(df)
    got = {r.conv_id: r for r in chat_format.digest(turns).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        r = got[c]
        loss = "".join(t for role, t in said if role == "assistant")
        whole = chat_format.chatml([(chat_format.escape_role(a), chat_format.escape(b)) for a, b in said])
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars, r.rewrites, r.altered) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole), False, False)


# --- all of them


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    said = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    outs = [
        mpeg_audio.read_media(mpeg_audio.store_text(docs)), line_templates.drop_templates(docs), decontaminate.digest(decontaminate.match_items(docs, bench)), decontaminate.remove_items(docs, bench), token_attribution.section_tokens(docs, ranks_path()),
        nnls_packing.pack(docs, ranks_path()), byte_cnn.keep_good(docs, labels), secret_scan.scan(docs), simhash_dedup.near_duplicates(docs), simhash_dedup.keep_first(docs), chat_format.digest(chat_format.format_turns(said)), bfd_packing.pack(docs, ranks_path()),
    ]
    assert [df.count() for df in outs] == [0] * len(outs)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four five", None, None, None), (None, None, None, None, None), (3, "one two three four five", None, None, None), (3, "one two three four five", None, None, None)], SCHEMA)
    assert mpeg_audio.read_media(mpeg_audio.store_text(docs)).count() == 4
    assert {(r.doc_id, r.text) for r in line_templates.drop_templates(docs).collect()} == {(None, "one two three four five"), (None, None), (3, "")}
    assert sum(r.length for r in nnls_packing.pack(docs, ranks_path()).collect()) == sum(len(encode(ranks_path(), r.text or "")) + 1 for r in docs.collect())
    assert simhash_dedup.near_duplicates(docs).count() == 4
    assert sorted((r.doc_id is None, r.text is None) for r in simhash_dedup.keep_first(docs).collect()) == [(False, False), (True, True)]
    assert bfd_packing.pack(docs, ranks_path()).count() >= 1 and secret_scan.scan(docs).count() == 4
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")
    assert byte_cnn.keep_good(docs, labels).count() == 4


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        whole = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        a, b = (whole[rng.random(len(whole)) < rng.random()] for _ in range(2))
        assert simhash_dedup.least_difference(simhash_dedup.parities(a), simhash_dedup.parities(b)) <= len(np.setxor1d(a, b))
    one, two = (np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(2))
    assert simhash_dedup.least_difference(simhash_dedup.parities(one), simhash_dedup.parities(two)) > 0.4 * 3000
    assert simhash_dedup.least_difference(simhash_dedup.parities(one), simhash_dedup.parities(one[:2700])) > 100
