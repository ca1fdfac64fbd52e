"""The flow's optimum against cuts over all sets of sources, and mixes of overlapping sources."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing


def largest_flow(supply, quota, passes: int) -> int:
    """The least cut: over all sets of sources, the quotas outside and the supply that reaches inside."""
    best = None
    for k in range(len(quota) + 1):
        for inside in map(set, itertools.combinations(quota, k)):
            cut = sum(q for s, q in quota.items() if s not in inside) + passes * sum(x for p, x in supply.items() if inside & set(p))
            best = cut if best is None else min(best, cut)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_optimal(seed):
    """All that can be routed is, and no other flow of that size repeats less."""
    r = random.Random(seed)
    names = list("abcde")[: r.randrange(1, 6)]
    patterns = [p for k in range(1, len(names) + 1) for p in itertools.combinations(names, k)]
    supply = {p: r.randrange(1, 60) for p in r.sample(patterns, r.randrange(1, min(9, len(patterns) + 1)))}
    quota = {s: r.randrange(0, 130) for s in names}
    times = r.randrange(1, 4)
    flow = mixing.min_cost_flow(supply, quota, times)
    assert all(x >= 0 and s in p for (p, s), x in flow.items())
    for s in names:
        assert sum(x for (_, t), x in flow.items() if t == s) <= quota[s]
    used = {p: sum(x for (q, _), x in flow.items() if q == p) for p in supply}
    assert all(used[p] <= times * supply[p] for p in supply)
    flows = [0, *(largest_flow(supply, quota, k) for k in range(1, times + 1))]
    assert sum(used.values()) == flows[times]
    assert sum(k * max(0, min(used[p], k * supply[p]) - (k - 1) * supply[p]) for p in supply for k in range(1, times + 1)) == sum(k * (b - a) for k, (a, b) in enumerate(zip(flows, flows[1:]), 1))


def test_flow_of_many_patterns():
    r = random.Random(1)
    names = [f"s{i:02d}" for i in range(24)]
    supply = {}
    while len(supply) < 50_000:
        supply[tuple(sorted(r.sample(names, r.randrange(1, 7))))] = r.randrange(1, 10_000)
    total = sum(supply.values())
    began = time.time()
    flow = mixing.min_cost_flow(supply, {s: round(1.5 * total * (1 + i % 3) / 48) for i, s in enumerate(names)}, 2)
    print(f"{len(supply)} patterns: {time.time() - began:.1f} s")
    assert sum(flow.values()) == sum(round(1.5 * total * (1 + i % 3) / 48) for i in range(24)) and time.time() - began < 60


def test_mix_of_overlapping_sources(spark):
    """Documents of one to three sources: what is taken meets each pattern's flow but for one document."""
    r = random.Random(2)
    rows = []
    for i in range(4000):
        of = sorted(r.sample(["a", "b", "c", None][: 4 if i % 9 == 0 else 3], r.choice([1, 1, 2, 3])), key=str) if i % 50 else []
        rows.append((i, of, r.randrange(0, 40)))
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n int").repartition(5)
    mixed, targets = mixing.mix(docs, "sources", F.col("n"), mixing.by_rank)
    got = {x.doc_id: x for x in mixed.collect()}
    target = {x.source: x for x in targets.collect()}
    assert len(got) == len(rows) and all(0 <= x.repeats <= 2 for x in got.values()) and all(got[i].repeats == 0 for i in range(0, 4000, 50))
    supply: dict = {}
    for _, of, n in rows:
        supply[tuple(sorted(of, key=lambda s: (s is not None, s or "")))] = supply.get(tuple(sorted(of, key=lambda s: (s is not None, s or ""))), 0) + n
    for s, x in target.items():
        assert x.source_size == sum(n for _, of, n in rows if s in of)
    quota = {s: int(x.target + 0.5) for s, x in target.items()}
    flow = mixing.min_cost_flow({p: x for p, x in supply.items() if p and x}, quota, 2)
    assert sum(flow.values()) == sum(quota.values())
    want: dict = {}
    for (p, _), x in flow.items():
        want[p] = want.get(p, 0) + x
    taken: dict = {}
    for x in got.values():
        p = tuple(sorted(x.sources, key=lambda s: (s is not None, s or "")))
        taken[p] = taken.get(p, 0) + x.repeats * x.size
    assert sum(taken.values()) == pytest.approx(sum(quota.values()), abs=20 * len(want)) and all(abs(taken[p] - want[p]) <= 40 for p in want if len(p) != 0)
    again = {x.doc_id: x.repeats for x in mixing.mix(docs.repartition(2), "sources", F.col("n"), mixing.by_rank)[0].collect()}
    assert again == {i: x.repeats for i, x in got.items()}
