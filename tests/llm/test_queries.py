"""The registered queries on the smallest tables: against SQL, brute force or held-out accuracy."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import entries
from compare import rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages benchmark labels conversations".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT * FROM documents ORDER BY doc_id").df()


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, con, name):
    assert rows(entries.queries()[name](spark, SF).toPandas()) == rows(con.execute(entries.oracle_sql()[name]).df())


def test_language_id(spark, docs):
    got = entries.op2_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    assert len(got) == len(docs) and (got["held_out"] == held).all()
    assert (got["lang_pred"] == got["lang"])[held].mean() >= 0.97 and got["accepted"].mean() > 0.98


def test_fingerprints(spark, docs):
    got = entries.op4_order_minhash(spark, SF).toPandas().set_index("doc_id")
    down = docs.sort_values("doc_id", ascending=False)
    texts = down["text"].tolist()
    for i, a, b in zip(down["doc_id"], texts, texts[1:] + texts[:1]):
        half = len(a) // 2
        assert got["n_chars"][i] == len(a)
        assert got["edited_sha256"][i] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
    assert got["near_edited"].mean() > 0.08 > 0.02 > got["near_next"].mean()
    assert got.groupby(docs.set_index("doc_id")["text"])["fingerprint"].nunique().max() == 1


def test_sharding(spark, docs):
    got = entries.op6_sharding(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (got["text_crc32"] == [zlib.crc32(t.encode()) for t in got["text"]]).all() and (got["size"] == [len(t.encode()) + 1 for t in got["text"]]).all()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 2 * got["size"].max()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(public_tokenizers.path(entries.VOCABULARY)), 0
    got = entries.op9_token_files(spark, SF).toPandas().sort_values("doc_id")
    for text, r in zip(docs["text"], got.itertuples()):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_pipeline(spark, docs, con):
    """Each stage against brute force over what the stage before kept."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.materialize(stage(spark, table, SF), name)
        kept.append(table.toPandas())
        assert list(table.columns[:5]) == list(docs.columns)
    spoken, single, clean, mixed, shards = kept
    assert len(spoken) >= 0.98 * len(docs)

    sets = {i: shingles(t) for i, t in zip(spoken["doc_id"], spoken["text"])}
    root = {i: i for i in sets}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for x in holders.values() for a in x for b in x if a < b}
    for a, b in sorted(pairs):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert sorted(single["doc_id"]) == sorted(i for i, r in root.items() if i == r)

    items = [shingles(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    want = [i for i in single["doc_id"] if not any(s and 100 * len(s & sets[i]) >= 75 * len(s) for s in items)]
    assert sorted(clean["doc_id"]) == sorted(want)

    size = clean.assign(n=[len(WORD.findall(t)) for t in clean["text"]]).set_index("doc_id")
    copies = mixed["doc_id"].value_counts()
    assert copies.max() <= 2 and set(copies.index) <= set(size.index)
    taken = (size["n"] * copies.reindex(size.index, fill_value=0)).sum()
    assert abs(taken - 1.5 * size["n"].sum()) <= 0.02 * size["n"].sum()
    assert sorted(shards["doc_id"]) == sorted(mixed["doc_id"])
    assert all(sorted(x) == list(range(len(x))) for _, x in shards.groupby("shard")["slot"])
