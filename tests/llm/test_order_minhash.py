"""Order MinHash against a plain-Python version, all columns, and ids that many rows share."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import fingerprint

from .test_edges import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def xx(*values) -> int:
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little") if abs(v) >> 31 else v.to_bytes(4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def long(*values) -> int:
    """As xx, with every number as 64 bits."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_signature(text: str) -> list[int]:
    units = re.findall(r"[^\x20\x09-\x0D]{1,8}", text.translate(LOWER))
    kmers = [xx(*units[i : i + 3]) for i in range(len(units) - 2)] if len(units) >= 3 else [xx(" ".join(units))] if units else []
    seen: dict[int, int] = {}
    circle = []
    for p, k in enumerate(kmers):
        n = seen.get(k, 0)
        seen[k] = n + 1
        h = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest((k & (1 << 64) - 1).to_bytes(8, "little"), seed=42))
        circle.append((h - (1 << 64) if h >> 63 else h, p))
    circle.sort()
    out = []
    for mark in range(64 if circle else 0):
        at = next((i for i, (h, _) in enumerate(circle) if h >= -(1 << 63) + mark * (1 << 58)), 0)
        two = [circle[at], circle[(at + 1) % len(circle)]] if len(circle) > 1 else [circle[at]]
        out.append(long(*[h for h, _ in sorted(two, key=lambda x: x[1])]))
    return out


def brute_likeness(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else sum(x == y for x, y in zip(a, b)) / 64


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_all_columns(spark, blocks):
    r = random.Random(4)
    texts = [words(n, n) for n in (1, 2, 3, 4, 20, 63, 64, 65, 130, 700, 3000)] + ["", None, " \n", "é😀 Ärger " * 30, "same line here now " * 50, words(40, 7) + " " + words(40, 7)]
    texts += [r.choice(texts) for _ in range(20)]
    rows = [(3 * i - 9, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), blocks).collect()}
    down = sorted(((i, t or "") for i, t in rows), reverse=True)
    form = lambda s: "".join(f"{v & (1 << 64) - 1:016x}" for v in s)
    assert len(got) == len(rows)
    for (i, a), (_, b) in zip(down, down[1:] + down[:1]):
        half, x = len(a) // 2, got[i]
        edited = a[: len(a) - half] + b[:half]
        sa, sb, se = brute_signature(a), brute_signature(b), brute_signature(edited)
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(a), hashlib.sha256(edited.encode()).hexdigest(), form(sa), form(se))
        assert (x.near_edited, x.near_next) == (brute_likeness(sa, se), brute_likeness(sa, sb))


def test_an_id_of_many_rows(spark):
    """Two thirds of the rows lack an id or share one: their texts' hashes cut them, and order them as in one block."""
    rows = [(None if i % 3 else i if i % 2 else 7, f"{words(6, i)} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    base = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("t"), "doc_id")
    cuts = fingerprint._cuts(base, 20)
    assert sum(i == -(1 << 63) and t < (1 << 63) - 1 for i, t in cuts) >= 10
    one, many = (sorted((str(x.doc_id), x.edited_sha256, x.near_next) for x in fingerprint.fingerprints(docs, b).collect()) for b in (1, 20))
    assert one == many and len(one) == 300
