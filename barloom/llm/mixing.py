"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Patterns of two sources or more that the driver's flow problem may have; those of one source are as
#: many as there are sources, and do not count.
MAX_PATTERNS = 1_000_000
#: Rows up to which a table of patterns is broadcast; beyond it the join shuffles.
BROADCAST_PATTERNS = 100_000


def capped_targets(sizes: dict, weights: dict, total: float, times: float) -> dict:
    """Shares of total by weight, none above times its size; what is above is reshared."""
    free, out = set(sizes), {}
    while free:
        w = sum(weights[s] for s in sorted(free, key=str))
        rest = total - sum(out[s] for s in sorted(out, key=str))
        over = {s for s in free if rest * weights[s] / w > times * sizes[s]}
        if not over:
            return out | {s: rest * weights[s] / w for s in free}
        out |= {s: times * sizes[s] for s in over}
        free -= over
    return out


class _Routes:
    """Patterns, their sources, and the words that flow from one to the other, as arrays."""

    def __init__(self, supply: dict, quota: dict):
        self.names = list(quota)
        place = {s: i for i, s in enumerate(self.names)}
        self.patterns = sorted(supply, key=lambda p: (len(p), str(p)))
        arcs = [(i, place[s]) for i, p in enumerate(self.patterns) for s in p if s in place]
        self.p, self.s = (np.array(x, dtype=np.int64) for x in zip(*arcs)) if arcs else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.flow = np.zeros(len(arcs), dtype=np.int64)
        self.free = np.zeros(len(self.patterns), dtype=np.int64)
        self.need = np.array([quota[s] for s in self.names], dtype=np.int64)
        order = np.argsort(self.s, kind="stable")
        ends = np.searchsorted(self.s[order], np.arange(len(self.names) + 1))
        self.arcs = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]  # by source
        first = np.r_[0, np.flatnonzero(np.diff(self.p)) + 1, len(self.p)] if len(self.p) else np.array([0])
        shared: dict = {}
        for a, b in zip(first[:-1], first[1:]):  # arcs of one pattern follow each other
            for i in range(a, b):
                for j in range(a, b):
                    if i != j:
                        shared.setdefault(int(self.s[i]), {}).setdefault(int(self.s[j]), []).append((i, j))
        #: By source and other source: the arcs of the patterns that lie in both, aligned.
        self.shared = {s: {t: np.array(x).T for t, x in sorted(to.items())} for s, to in shared.items()}

    def draw(self, s: int, words: int) -> None:
        """Gives source s so many words from free supply."""
        arcs = self.arcs[s]
        took = _spread(self.free[self.p[arcs]], words)
        self.free[self.p[arcs]] -= took
        self.flow[arcs] += took

    def reroute(self, s: int, t: int, words: int) -> None:
        """Moves so many words from source s to source t, within the patterns that lie in both."""
        a, b = self.shared[s][t]
        took = _spread(self.flow[a], words)
        self.flow[a] -= took
        self.flow[b] += took

    def fill(self) -> None:
        """A largest flow from the free supply to the needs: what fits directly, then along shortest rerouted paths."""
        for s in range(len(self.names)):
            words = int(min(self.need[s], self.free[self.p[self.arcs[s]]].sum()))
            self.draw(s, words)
            self.need[s] -= words
        while True:
            queue = [int(s) for s in np.flatnonzero(self.need > 0)]
            to: dict = dict.fromkeys(queue)  # which source a source gives its words to
            for s in queue:
                there = int(self.free[self.p[self.arcs[s]]].sum())
                if there:
                    break
                for t, (_, theirs) in self.shared.get(s, {}).items():
                    if t not in to and self.flow[theirs].any():
                        to[t] = s
                        queue.append(t)
            else:
                return
            path = [s]
            while to[path[-1]] is not None:
                path.append(to[path[-1]])
            words = min([there, int(self.need[path[-1]]), *[int(self.flow[self.shared[x][y][0]].sum()) for x, y in zip(path, path[1:])]])
            for x, y in zip(path, path[1:]):
                self.reroute(x, y, words)
            self.draw(s, words)
            self.need[path[-1]] -= words


def _spread(there: np.ndarray, words: int) -> np.ndarray:
    """How much of each amount makes up so many words, first ones first."""
    before = np.cumsum(there) - there
    return np.clip(words - before, 0, there)


def min_cost_flow(supply: dict, quota: dict, times: int) -> dict:
    """Words routed from each pattern (a tuple of sources) to each source.

    A pattern's first pass costs 1 a word, its second 2, and so on up to `times`: convex, so
    repetition is spread before it deepens. Arcs inside cost nothing, so shortest augmenting paths start
    at the lowest open pass: pass after pass, a largest flow extends the one before. Paths run over
    sources; the patterns that two sources share are one arc of the residual graph between them.
    """
    routes = _Routes(supply, quota)
    for _ in range(times):
        routes.free += np.array([supply[p] for p in routes.patterns], dtype=np.int64)
        routes.fill()
    return {(routes.patterns[p], routes.names[s]): int(f) for p, s, f in zip(routes.p, routes.s, routes.flow)}


def mix(
    docs: DataFrame, sources: str, size: Column, weights, share: float = 1.5, times: int = 2, seed: str = "mix"
) -> tuple[DataFrame, DataFrame]:
    """(docs' columns + size, repeats; targets of the sources).

    `sources` names an array column: all the sources a document belongs to (null elements
    are a source of their own). weights(list of sources in order) gives their weights; the
    sources share `share` times all sizes by weight, but none takes more than `times` its size.

    1. Sizes are summed by membership pattern; the driver gets one row for each pattern (of
       those that overlap at most MAX_PATTERNS, else an error) and routes whole words to the quotas.
    2. A pattern that gives f words repeats all its documents f div supply times, and of the
       rest selects documents in the order of a seeded hash, up to the last that fits, then
       the single document that comes nearest to what is left. The order is cut by hash
       buckets' sums; only one bucket in 4,096 of a pattern is ever sorted.

    Whole documents are taken: `repeats` is 0 to `times`. A document without a source (a null or empty
    array) is taken 0 times. Null or empty texts have size 0, very long ones their whole size;
    they fit whenever their place in the order does. Repeated rows are decided one by one. An empty table
    gives empty results. Columns of docs named size or repeats give way to the results'; names that start
    with "__" are the operator's own.
    """
    spark = docs.sparkSession
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.withColumn("__n", size.cast("long")).drop("size", "repeats")
    slim = docs.withColumns(
        {"size": F.col("__n"), "__sources": F.array_distinct(F.array_sort(sources)), "__h": h, "__rid": F.monotonically_increasing_id()}
    )
    slim = slim.withColumns({"__key": F.to_json(F.struct("__sources")), "__bucket": F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")})
    slim = materialize(slim, "sizes")
    buckets = materialize(slim.groupBy("__key", "__bucket").agg(F.first("__sources").alias("__sources"), F.sum("size").alias("s")), "buckets")
    rows = buckets.groupBy("__key").agg(F.first("__sources").alias("p"), F.sum("s").alias("s"))
    n, several = rows.agg(F.count("*"), F.count_if(F.size("p") > 1)).first()
    if several > MAX_PATTERNS:
        raise ValueError(f"{several} patterns of several sources; the flow problem is limited to {MAX_PATTERNS}")

    def sent(a_row_a_pattern: DataFrame) -> DataFrame:
        return F.broadcast(a_row_a_pattern) if n <= BROADCAST_PATTERNS else a_row_a_pattern

    found = sorted((r["__key"], tuple(r["p"] or ()), r["s"]) for r in rows.collect())
    names = sorted({s for _, p, _ in found for s in p}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for _, p, x in found:
        for s in p:
            sizes[s] += x
    target = capped_targets(sizes, dict(zip(names, weights(names))), share * sum(x for *_, x in found), times)
    flow = min_cost_flow({p: x for _, p, x in found if x}, {s: math.floor(target[s] + 0.5) for s in names}, times)
    plan = []
    for key, p, x in found:
        f = sum(flow.get((p, s), 0) for s in p) if x else 0
        plan.append((key, f // x if x else 0, f % x if x else 0))
    plan = spark.createDataFrame(plan, "__key string, __base int, __rest long")

    cum = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = buckets.select("__key", "__bucket", "s", F.sum("s").over(cum).alias("c")).join(sent(plan), "__key")
    edge = edge.where((F.col("c") > F.col("__rest")) & (F.col("c") - F.col("s") <= F.col("__rest")))
    edge = edge.groupBy("__key").agg(F.min("__bucket").alias("__edge"), F.min(F.col("c") - F.col("s")).alias("__before"))
    plan = sent(plan.join(sent(edge), "__key", "left"))

    slim = slim.join(plan, "__key", "left")
    key_cols = ["__key", "__rid", "size"]
    inside = slim.where("__bucket = __edge").select(*key_cols, "__h", "__before", "__rest")
    order = Window.partitionBy("__key").orderBy("__h", "size", "__rid").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("c", F.sum("size").over(order) + F.col("__before"))
    inside = materialize(inside.select("__key", "__rid", "size", "c", "__rest", "__h"), "edge")
    taken = inside.where("c <= __rest").groupBy("__key").agg(F.max("c").alias("__sum"))
    # the last place that still fits, by pattern; then the nearest single document after it
    limit = inside.where("c <= __rest").groupBy("__key").agg(
        F.max_by("__h", F.struct("c", "__h", "size", "__rid")).alias("__h1"), F.max_by(F.struct("size", "__rid"), F.struct("c", "__h", "size", "__rid")).alias("__x1")
    )
    gap = sent(plan.join(taken, "__key", "left").join(limit, "__key", "left").where("__edge is not null").select("__key", (F.col("__rest") - F.coalesce("__sum", "__before")).alias("__gap"), "__h1", "__x1"))
    slim = slim.join(gap, "__key", "left")
    fits = F.col("__edge").isNull() & (F.col("__rest") > 0) | (F.col("__bucket") < F.col("__edge")) | (
        (F.col("__bucket") == F.col("__edge")) & ((F.col("__h") < F.col("__h1")) | ((F.col("__h") == F.col("__h1")) & (F.struct("size", "__rid") <= F.col("__x1"))))
    )
    slim = slim.withColumn("__fits", F.coalesce(fits, F.lit(False)))
    near = slim.where("not __fits and size > 0 and abs(size - __gap) < __gap").groupBy("__key").agg(
        F.min_by("__rid", F.struct(F.abs(F.col("size") - F.col("__gap")), "__h", "size", "__rid")).alias("__extra")
    )
    slim = slim.join(sent(near), "__key", "left")
    repeats = F.col("__base") + F.when(F.col("__fits") | F.coalesce(F.col("__extra") == F.col("__rid"), F.lit(False)), 1).otherwise(0)
    out = slim.select(*[F.col(f"`{c}`") for c in docs.columns if c != "__n"], "size", F.coalesce(repeats, F.lit(0)).cast("int").alias("repeats"))
    by_source = spark.createDataFrame([(s, sizes[s], float(target[s])) for s in names], "source string, source_size long, target double")
    return out, by_source


def by_rank(names: list) -> list[int]:
    """The weights 3, 1, 2, repeating, of the sources in order."""
    return [(3, 1, 2)[i % 3] for i in range(len(names))]
