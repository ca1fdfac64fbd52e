"""Connected components as DataFrame rounds (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    up = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) of ids -> (id, component): each linked id and the least id it reaches.

    Nulls and self-links carry nothing. Minima are taken with map-side combination and
    joined back, so a hub's neighbours never meet in one task; AQE splits its join.
    Each round is a written table in the shared folder.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        nxt = materialize(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = nxt
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = materialize(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "components")
    discard(edges)
    return out
