"""Sharding by sampled splitters over (text hash, doc_id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, literal, materialize, partitions, rank_in

#: Key ranges for each shard at least, and sampled keys for each range.
RANGES_A_SHARD, SAMPLES_A_RANGE = 16, 32
#: Parts of a shard's even share: a group heavier than one is subdivided, a lighter one stays whole.
PARTS = 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
Key = tuple[int, int]


def _range(k1: Column, k2: Column, splitters: list[Key]) -> Column:
    """The number of splitters at or below a key."""
    known = literal([{"k1": a, "k2": b} for a, b in splitters], "struct<k1:bigint,k2:bigint>")
    return rank_in(known, F.struct(k1.alias("k1"), k2.alias("k2")), len(splitters))


def _sample(rows: DataFrame, rate: float, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with probability min(1, weight * rate), by a hash: reruns agree."""
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = rows.where(u < F.col("w") * F.lit(rate)).select("k1", "k2", F.greatest(F.lit(1.0), F.col("w") * F.lit(rate)).alias("x"))
    return sorted(tuple(r) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int, float]], n: int) -> set[Key]:
    """The keys at which the sample's weight passes i/n of its sum."""
    total, seen, i, out = sum(x for *_, x in sample), 0.0, 1, set()
    for a, b, x in sample:
        seen += x
        if seen >= i * total / n:
            out.add((a, b))
            while seen >= i * total / n:
                i += 1
    return out


def _middle(lo: Key, hi: Key) -> Key:
    """A key above lo and at most hi, half way between them."""
    return ((lo[0] + hi[0]) // 2 + 1, _LEAST) if lo[0] < hi[0] else (lo[0], (lo[1] + hi[1]) // 2 + 1)


def _splitters(rows: DataFrame, total: int, n: int, hot: dict[int, int], seed: int) -> tuple[list[Key], list]:
    """Splitters of ranges of at most twice an even share (or of one key), and the ranges' statistics.

    Ranges end where a text's group does, but hot groups are ranges of their own, cut by the id.
    A range that is too full is sampled again; where the sample does not cut it, its middle does,
    so rounds end: a range holds different keys only while it can be halved.
    """

    def whole(keys: set[Key]) -> set[Key]:
        return {(a, b if a in hot else _LEAST) for a, b in keys}

    out = whole(_quantiles(_sample(rows, n * SAMPLES_A_RANGE / total, seed), n))
    out |= {(k + d, _LEAST) for k in hot for d in (0, 1) if k + d <= _MOST}
    attempt = 0
    while True:
        attempt += 1
        ranged = rows.withColumn("range", _range(F.col("k1"), F.col("k2"), sorted(out)))
        stats = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
        found = sorted(stats.collect(), key=lambda r: r["range"])
        ends = {r["range"]: (tuple(r["lo"]), tuple(r["hi"]), r["w"]) for r in found}
        over = {r: x for r, x in ends.items() if x[2] > 2 * total / n and (x[0][0] != x[1][0] or x[0][0] in hot and x[0] != x[1])}
        if not over:
            return sorted(out), found
        again = _sample(ranged.where(F.col("range").isin(list(over))), n * SAMPLES_A_RANGE / total, seed + attempt)
        for lo, hi, w in over.values():
            keys = {k for k in whole(_quantiles([x for x in again if lo < x[:2] <= hi], max(2, round(w * n / total)))) if lo < k <= hi}
            out |= keys - out or {_middle(lo, hi)}


def shard(df: DataFrame, weight: str, hashed: str, ident: str, shards: int = 8, seed: int = 17) -> DataFrame:
    """df with the columns shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Rows lie in the order of the key (hashed, ident), with a hash of the text first, so equal
    texts are neighbours: a group. A group goes whole to the shard in which its middle lies,
    if equal weights are cut from the sum; a group heavier than an eighth of a shard's even share is
    cut between rows, each by its own middle. So a shard is off its even share by at most an eighth
    of it, or by its largest row.

    1. A weight-proportional sample (32 keys a range expected, whatever the input) gives the quantile
       splitters of 16 ranges a shard, more if the session has more shuffle partitions.
    2. Exact counts and weights of the ranges; those over twice their share are subdivided until none is.
       The groups that may be cut (at most 8 x shards of them) are ranges of their own.
    3. Only a range is ever sorted in one task; prefix sums of the ranges' totals turn its
       running sums into places in the whole.

    Shard and slot depend on the rows alone, not on the splitters. Nulls in the key come first;
    rows of equal key (and they alone) stay in one range, in unspecified order. Null, empty and very
    long texts differ in their weight only. An empty table returns no rows. Columns of df named shard or
    slot give way to the results; names that start with "__" are the operator's own.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    keyed = df.withColumns(
        {"__k1": F.coalesce(F.col(hashed), F.lit(_LEAST)), "__k2": F.coalesce(F.col(ident), F.lit(_LEAST)), "__w": F.col(weight).cast("long")}
    )
    rows = materialize(keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__w").alias("w")), "keys")
    total = rows.agg(F.sum("w")).first()[0]
    hot: dict[int, int] = {}
    cuts, stats = [], []
    if total:
        groups = rows.groupBy("k1").agg(F.sum("w").alias("w")).where(F.col("w") * F.lit(PARTS * shards) > F.lit(total))
        hot = {r["k1"]: r["w"] for r in groups.collect()}  # fewer than PARTS * shards
        n = shards * max(RANGES_A_SHARD, math.ceil(2 * partitions(spark) / shards))
        cuts, stats = _splitters(rows, total, n, hot, seed)

    bases, rows_before, weight_before = [], 0, 0
    for r in stats:
        bases.append((r["range"], rows_before, weight_before))
        rows_before, weight_before = rows_before + r["n"], weight_before + r["w"]
    base = F.broadcast(spark.createDataFrame(bases, "__range int, __n long, __b long"))  # a row a range

    def placed(x: DataFrame) -> DataFrame:
        """x with its shard, by twice the middle of its group (of its row, in a hot group), and rank."""
        order = Window.partitionBy("__range").orderBy("__k1", "__k2", "__w")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        groups = Window.partitionBy("__range").orderBy("__k1").rangeBetween(Window.unboundedPreceding, 0)
        in_group = Window.partitionBy("__range", "__k1").orderBy("__k2", "__w").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("__range", _range(F.col("__k1"), F.col("__k2"), cuts))
        x = x.withColumns({"__i": F.row_number().over(order), "__s": F.sum("__w").over(so_far), "__e": F.sum("__w").over(groups)})
        x = x.withColumn("__g", F.first(F.col("__s") - F.col("__w")).over(in_group))
        own = F.col("__k1").isin(list(hot)) if hot else F.lit(False)
        twice = 2 * F.col("__b") + F.when(own, 2 * F.col("__s") - F.col("__w")).otherwise(F.col("__g") + F.col("__e"))
        x = x.join(base, "__range").withColumn("__twice", twice)
        cut = F.expr(f"least({shards - 1}, __twice * {shards} div {2 * (total or 1)})").cast("int")
        return x.withColumns({"shard": cut, "__rank": F.col("__n") + F.col("__i")})

    slim = placed(rows.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("w").alias("__w")))
    first = [tuple(r) for r in slim.groupBy("shard").agg(F.min("__rank")).collect()]
    discard(rows)
    first = F.broadcast(spark.createDataFrame(first, "shard int, __first long"))
    return placed(keyed).join(first, "shard").select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col("__rank") - F.col("__first")).cast("long").alias("slot"))
