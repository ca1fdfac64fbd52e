"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, decontam, fingerprint, langid, minhash, mixing, sharding, suffix_dedup, tokens, warc
from barloom.llm.entries import n_words, sized

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, shard int, kept boolean, component_id long, n int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


BASE, LONG = words(120, 1), words(30_000, 2)
NEAR = BASE.rsplit(" ", 3)[0] + " zz yy"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "de", "a"),
    (7, "one two", "de", "b"), (8, "ONE  two", None, "a"), (9, LONG, "en", "a"), (None, BASE, "en", None), (10, words(80, 3), "en", "c"),
    (10, words(80, 3), "en", "c"), (11, words(60, 4) + " " + " ".join(BASE.split()[20:90]), None, "c"), (12, "1234 !!", "en", "a"), (13, "é" * 50 + "😀", "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, 2, 3, False, 4, 5) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_duplicates(docs, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    by_id = {r[0]: r for r in got}
    assert len(got) == len(ROWS) and by_id[1][2:] == (1, True) and by_id[2][2:] == (1, False) and by_id[3][2:] == (1, False)
    assert by_id[-1][2:] == (1, False) and by_id[4][1:] == by_id[5][1:][:0] + (0, 4, True) and by_id[6][1:] == (0, 6, True)
    assert by_id[7][1:] == (1, 7, True) and by_id[8][1:] == (1, 7, False)  # the whole sequence, ASCII case aside
    assert [r[2:] for r in got if r[0] == 10] == [(10, True)] * 2
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_rows_without_ids(spark):
    """Rows that lack or share an id are linked by their own texts."""
    a, b = words(60, 31), words(60, 32)
    rows = [(None, a), (None, a + " x"), (5, b), (5, a + " y"), (7, b + " z"), (None, words(40, 33)), (None, ""), (9, words(40, 33) + " q"), (None, words(30, 35)), (None, words(30, 35))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1))
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got.collect())
    n = {t: len({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for _, t in rows}
    want = [(0, n[a], 5, False), (0, n[a + " x"], 5, False), (5, n[b], 5, True), (5, n[a + " y"], 5, True), (7, n[b + " z"], 5, False), (0, n[words(40, 33)], 9, False), (0, 0, 0, True), (9, n[words(40, 33) + " q"], 9, True)]
    assert found == sorted([*want, (0, n[words(30, 35)], 0, True), (0, n[words(30, 35)], 0, False)])


STAGE_ROWS = [(1, BASE, "en", "a"), (1, words(90, 51), "en", "a"), (None, words(70, 52), "en", None), (None, words(70, 52), "en", None), (2, None, None, None), (3, "", "en", "b"), (4, LONG, "en", "b"), (5, BASE, "en", "b"), (5, BASE, "en", "b")]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, docs, stage, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names in each stage."""
    import corpus_pipeline

    names = ["size", "shard", "slot", "row", "id", "repeats", "n", "sources", "copy", "kept", "__row"]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in STAGE_ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    table = table.withColumns({c: F.lit(i) for i, c in enumerate(names[: -1 if stage == 1 else None])}).repartition(2)
    spark.createDataFrame([(1, " ".join(LONG.split()[900:940])), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, table, str(tmp_path))
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in got.collect())
    all_ = sorted((r[0] or 0, len(r[1] or "")) for r in STAGE_ROWS)
    if name == "sharding":
        assert got.columns == [*[c for c in table.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot"] and kept == all_
    else:
        assert got.columns == table.columns
    if name == "language_id":
        assert (2, 0) not in kept and (3, 0) not in kept
    if name == "near_dedup":
        assert kept == sorted([(0, len(words(70, 52))), (1, len(BASE)), (1, len(words(90, 51))), (2, 0), (3, 0), (4, len(LONG))]) or (5, len(BASE)) in kept and len(kept) == 6
    if name == "decontamination":
        assert kept == [x for x in all_ if x[0] != 4]
    if name == "mixing":
        assert set(kept) <= set(all_) and all(kept.count(x) <= 2 * all_.count(x) for x in kept)
    assert run(spark, table.limit(0), str(tmp_path)).count() == 0


def test_least_matches_bounds_the_miss():
    for n in (20, 100, 200):
        m = minhash.least_matches(n, 0.75, 1e-6)
        draws = np.random.default_rng(1).beta(m, n - m + 2, 200_000) if m else np.zeros(1)
        assert (draws >= 0.75).mean() < 1e-3 and m < 0.75 * n


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Many texts around a shared core, checked against all pairs, with tiny blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    core = words(60, 9).split()
    texts = [" ".join(core[: 60 - i % 7] + words(8 + i % 9, 100 + i).split()) for i in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == dict(enumerate(root))


def test_repeated_passages(spark, docs, none):
    got = sorted(tuple(r) for r in suffix_dedup.repeated_passages(docs).collect())
    assert {r[0] for r in got} == {1, 2, 3, 11} and (11, 60, 130, 70) in got and (1, 0, 120, 120) in got
    assert suffix_dedup.repeated_passages(none).count() == 0
    twice = spark.createDataFrame([(1, words(70, 5) + " x " + words(70, 5)), (2, words(90, 6))], "doc_id long, text string")
    assert suffix_dedup.repeated_passages(twice).count() == 0
    assert sorted(tuple(r) for r in suffix_dedup.repeated_passages(twice, within=True).collect()) == [(1, 0, 70, 70), (1, 71, 141, 70)]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[10:40])), (2, None), (3, ""), (4, "one TWO"), (None, words(20, 77)), (6, " ".join(LONG.split()[20_000:20_050]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (7, 4), (8, 4), (9, 6)}
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 10, 10, 11, 12, 13]
    assert decontam.contaminated(none, items).count() == 0 and decontam.decontaminate(docs, items.limit(0)).count() == len(ROWS)


def test_item_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BYTES_A_PASS", 4 * (decontam._ITEM_BYTES + 200))
    items = spark.createDataFrame([(i, " ".join(LONG.split()[i * 100 : i * 100 + 30])) for i in range(20)], "item_id long, text string")
    assert len(list(decontam._indexes(items, 75, 5))) >= 4
    assert sorted(r.item_id for r in decontam.contaminated(docs, items).collect()) == list(range(20))
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(docs, items).collect()) == sorted(r[0] or 0 for r in ROWS if r[0] != 9)


def test_language_id(spark, docs, none):
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(60)), lang) for i in range(120) for lang, a in [("xx", "abcde") if i % 2 else ("yy", "cdefg")]]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang in range(2):  # probabilities over an alphabet sum to one
        context = "abc "
        p = [np.exp(-model.entropies(context)[1][lang]) for _ in range(1)]
        assert 0 < p[0] <= 1
    got = {x.doc_id: x for x in langid.predict(docs, model).collect() if x.doc_id}
    odd = spark.createDataFrame([(1, "\u0301 \U0001d7cf \U00010107 12"), (2, "\u0301\U00020000")], "doc_id long, text string")  # marks, a digit, a number; a letter
    assert [x.lang_pred == "und" for x in sorted(langid.predict(odd, model).collect())] == [True, False]
    assert [got[i].lang_pred for i in (4, 5, 6, 12)] == ["und"] * 4 and got[4].score == 0 and not got[4].accepted
    assert not got[13].accepted and 0 <= got[9].score <= 1
    seen = langid.predict(spark.createDataFrame([(1, "abab abba baab"), (2, "gfgf fgfg ffgg")], "doc_id long, text string"), model).collect()
    assert [x.lang_pred for x in sorted(seen)] == ["xx", "yy"]
    kept = langid.keep_accepted(docs, model)
    assert kept.columns == docs.columns and not {4, 5, 6, 12} & {x.doc_id for x in kept.collect()}
    empty = langid.learn(none)
    assert langid.predict(docs, empty).where("lang_pred <> 'und'").count() == 0 and langid.predict(none, model).count() == 0


def test_fingerprints(docs, none):
    got = fingerprint.fingerprints(docs, blocks=3).collect()
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: -(r[0] if r[0] is not None else -(1 << 62)))
    assert len(got) == len(ROWS) and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    by_id = {x.doc_id: x for x in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[None].fingerprint and by_id[2].near_next == 1.0
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        seen = [(x.n_chars, x.edited_sha256) for x in got if x.doc_id == i]  # repeated rows of an id follow each other
        assert (len(a), hashlib.sha256(edited.encode()).hexdigest()) in seen
    assert by_id[4].fingerprint == "" and by_id[3].near_next < 1 and fingerprint.fingerprints(none).count() == 0


def test_order_and_occurrence_count(spark):
    def sig(t):
        return spark.range(1).select(fingerprint.text_form(fingerprint.signature(F.lit(t)))).first()[0]

    a, b = words(200, 21), words(200, 22)
    assert sig(a + " " + b) != sig(b + " " + a) and sig(a) == sig(a.upper()) and sig(a + " " + a) != sig(a)
    assert sig("x y") != sig("y x") and sig("x") and not sig("")


def test_sharding(docs, none):
    rows = sized(docs.drop("size"))
    got = sharding.shard(rows, "size", "hashed", "doc_id").collect()
    assert len(got) == len(ROWS) and all(0 <= r["shard"] < 8 for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(sized(none), "size", "hashed", "doc_id").count() == 0


def test_shards_are_even(spark):
    r = random.Random(5)
    data = spark.createDataFrame([(i, r.randrange(1, 400), 7 if i % 3 else r.randrange(1 << 60)) for i in range(20_000)], "doc_id long, size long, hashed long").repartition(5)
    got = sharding.shard(data, "size", "hashed", "doc_id")
    sums = [x[1] for x in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 2 * 400
    again = {(x.doc_id, x["shard"], x.slot) for x in sharding.shard(data.repartition(3), "size", "hashed", "doc_id").collect()}
    assert again == {(x.doc_id, x["shard"], x.slot) for x in got.collect()}


def test_mixing(docs, none):
    for table, n in ((docs, len(ROWS)), (none, 0)):
        rows, targets = mixing.mix(table.withColumn("s", F.array("source")), "s", n_words(), mixing.by_rank)
        found = rows.collect()
        assert len(found) == n and all(0 <= r.repeats <= 2 for r in found)
    t = {r.source: r for r in mixing.mix(docs.withColumn("s", F.array("source")), "s", n_words(), mixing.by_rank)[1].collect()}
    assert set(t) == {"a", "b", "c", None} and all(x.target <= 2 * x.source_size + 1e-6 for x in t.values())


def test_overlapping_flow():
    flow = mixing.min_cost_flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 120}, 2)
    assert sum(x for (_, s), x in flow.items() if s == "a") == 150 and sum(x for (_, s), x in flow.items() if s == "b") == 120
    used = {p: sum(x for (q, _), x in flow.items() if q == p) for p in {p for p, _ in flow}}
    assert used[("a",)] == 100 and used[("b",)] <= 20
    assert sum(mixing.min_cost_flow({("a",): 5}, {"a": 100}, 2).values()) == 10


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "bot", "yo"), (4, 2, "user", ""),
        (5, None, None, None), (None, 0, "user", "lost"), (6, 1, "bot", "b"), (6, 1, "bot", "a"), (7, 0, "user", "hi"), (7, 0, "user", "hi"),
    ]
    t = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, id int")
    got = {r.conv_id: r for r in chat.collapse(t).collect()}
    assert set(got) == {3, 5, 6, 7, None} and got[3].copies == 2 and got[3].n_turns == 3
    assert got[6].chat == "<|bot|>\na\n<|bot|>\nb\n<|end|>" and chat.collapse(t.limit(0)).count() == 0


def test_tokens(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(tokens.encode_documents(docs, "word_bpe_49k.json").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(r[0] for r in ROWS if r[0])]
    text, at = {r[0]: r[1] or "" for r in ROWS}, 0
    for r in got:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert tokens.encode_documents(none, "word_bpe_49k.json").count() == 0


def test_rolled_parts(spark, docs, tmp_path):
    """Parts of a few bytes, in a folder without a scheme; other rules than the expected ones go to the library whole."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    want = sorted((r.start, r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in tokens.encode_documents(docs, "word_bpe_49k.json").collect())
    encoder = lambda: tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    manifest = tokens.write_tokens(docs, encoder, f"file://{tmp_path}/t", batch=1, roll=200)
    assert manifest.where("seq > 0").count() > 0 and manifest.count() > 5
    assert want == sorted((r.start, r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(manifest).collect())
    assert len(want) == len(tokens.encode_documents(docs, "word_bpe_49k.json", folder=str(tmp_path / "plain")).collect()) and list((tmp_path / "plain").iterdir())
    other = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    other["normalizer"]["normalizers"].pop()  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(other))
    e = tokens.Encoder(str(tmp_path / "other.json"), 2)
    text = "Some CAPITALS and more"
    assert not e.split and e.encode([text])[0] == np.array(e.tok.encode(text, add_special_tokens=False).ids + [2], dtype="<u2").tobytes() != encoder().encode([text])[0]


def test_the_applications_folder_is_known(spark):
    from barloom.llm import common

    path = common.shared_path(spark, "x")
    assert path.startswith("file:///") and spark.sparkContext.applicationId in path and common.qualified(spark, "/a b/c") == "file:///a b/c"


def test_pieces_are_the_librarys():
    import public_tokenizers

    e, r = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2), random.Random(1)
    texts = ["".join(r.choice("abcXYZ'’\"!?.,-0123 \n\t\x0b\x85\xa0éÉßøİıŸǅΣσςá中😀<|>’s²½") for _ in range(r.randrange(14))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)}'s" for c in range(0x250)] + ["x<|endoftext|>y"]
    for t, a in zip(texts, e.encode(texts)):
        assert a == np.array(e.tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u2").tobytes(), repr(t)


def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(5, "u", body), (2, "u v\n", body), (9, None, body), (3, "u", "short"), (4, "u", "short"), (1, "u", None), (6, "u", ""), (None, "u", body), (7, "é", "é" * 60), (2, "u", body)]
    rows += [(100 + i, f"http://x/{i}", f"<html>{words(50, i)}</html>") for i in range(60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by_id[2].record_type == "response" and by_id[5].refers_to == by_id[9].refers_to == 2
    assert by_id[5].record_type == "revisit" and by_id[5].payload is None and by_id[5].payload_bytes == len(body)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (by_id[i].payload_bytes, by_id[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert by_id[3].record_type == by_id[4].record_type == "response" and by_id[None].record_type == "response" and by_id[7].payload == "é" * 60
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_bad_archives():
    import io
    import struct

    import zstandard

    good = warc.record("response", 1, "u", hashlib.sha256(b"hello").hexdigest(), b"hello", 5)
    assert warc.parse(good)[2] == b"hello"
    for bad in (good[:-1], good.replace(b"hello", b"hallo"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Date"), good + b"x"):
        with pytest.raises(warc.Corrupt):
            warc.parse(bad)
    known = zstandard.ZstdCompressionDict(b"WARC/1.1 some raw content dictionary " * 20)
    z = zstandard.ZstdCompressor(dict_data=known)
    raw = known.as_bytes()
    for lead in (raw, zstandard.compress(raw)):
        file = struct.pack("<II", warc.DICT_MAGIC, len(lead)) + lead + z.compress(good) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + z.compress(good)
        for chunk in (1, 7, 1 << 20):
            assert list(warc.frames(io.BytesIO(file), chunk)) == [good, good]
        with pytest.raises(warc.Corrupt):
            list(warc.frames(io.BytesIO(file[:-3])))
