"""Shards and slots against a plain-Python version that knows no splitters."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import sharding


def placed(rows, shards: int) -> set:
    """(id, shard, slot) by sorted keys and prefix sums alone."""
    least = -(1 << 63)
    rows = sorted(rows, key=lambda r: (least if r[2] is None else r[2], least if r[0] is None else r[0], r[1]))
    total = sum(r[1] for r in rows)
    weight: dict = {}
    for r in rows:
        weight[r[2]] = weight.get(r[2], 0) + r[1]
    out, seen, start, slots = set(), 0, {}, [0] * shards
    for ident, size, key in rows:
        start.setdefault(key, seen)
        lo, hi = (seen, seen + size) if 8 * shards * weight[key] > total else (start[key], start[key] + weight[key])
        s = min(shards - 1, (lo + hi) * shards // (2 * total))
        out.add((ident, s, slots[s]))
        slots[s] += 1
        seen += size
    return out


@pytest.mark.parametrize(("seed", "kind"), [(1, "groups"), (2, "hot"), (3, "few"), (4, "heavy"), (5, "near")])
def test_placement(spark, seed, kind):
    r = random.Random(seed)
    keys = [r.randrange(-(1 << 62), 1 << 62) for _ in range({"groups": 300, "hot": 50, "few": 3, "heavy": 2000, "near": 40}[kind])]
    if kind == "near":  # all keys within one sampled gap
        keys = [10**15 + i for i in range(40)]
    rows = []
    for i in range(3000):
        key = keys[0] if kind == "hot" and i % 3 else r.choice(keys)
        rows.append((i if i % 50 else None, 50_000 if kind == "heavy" and i in (5, 6) else r.randrange(1, 90) if i % 50 else 7, key if i % 50 else None))
    data = spark.createDataFrame(rows, "doc_id long, size long, hashed long").repartition(4)
    got = sharding.shard(data, "size", "hashed", "doc_id").collect()
    mine = lambda x: sorted((str(a), b, c) for a, b, c in x)
    assert mine((x.doc_id, x["shard"], x.slot) for x in got) == mine(placed(rows, 8))
    groups = {}
    for x in got:
        groups.setdefault(x.hashed, []).append(x)
    total = sum(x.size for x in got)
    assert all(len({x["shard"] for x in g}) == 1 for g in groups.values() if 64 * sum(x.size for x in g) <= total)


def test_more_partitions_do_not_move_rows(spark):
    rows = [(i, 1 + i % 7, (i * i) % 311) for i in range(2000)]
    data = spark.createDataFrame(rows, "doc_id long, size long, hashed long").withColumn("hashed", F.xxhash64("hashed"))
    one = {(x.doc_id, x["shard"], x.slot) for x in sharding.shard(data, "size", "hashed", "doc_id").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        assert one == {(x.doc_id, x["shard"], x.slot) for x in sharding.shard(data, "size", "hashed", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
