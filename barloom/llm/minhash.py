"""Near-duplicate documents: banded MinHash candidates, Bayesian batches, exact links."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, lean, materialize, mix, pick, shingle_set, small_batches
from .components import components

#: Rows of a block in which members of one large bucket are compared.
BLOCK = 256


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (x[:k] >> U64(32)).astype(np.uint32) | np.uint32(1), (x[k:] >> U64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):  # blocks that stay in the cache
        np.minimum(out, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=out)
    return out


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of n equal values at which P(similarity >= threshold) is miss or more.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is
    the chance that a Binomial(n + 1, t) is at most m.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int) -> np.ndarray:
    """Which rows of two signature matrices stay possible links, batch after batch."""
    live = np.arange(len(a))
    found = np.zeros(len(a), dtype=np.int32)
    for i in range(0, a.shape[1], batch):
        if not len(live):
            break
        j = min(i + batch, a.shape[1])
        found[live] += (a[live, i:j] == b[live, i:j]).sum(axis=1, dtype=np.int32)
        live = live[found[live] >= least_matches(j, threshold, miss)]
    return live


def _signer(bands: int, rows: int, shingle: int):
    def sign(batches):
        a, b = hash_family(bands * rows)
        for pdf in batches:
            n, d1, d2, sig = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, shingle)
                m = mix(s)
                n.append(len(s))
                d1.append(int(m.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                d2.append(int(np.bitwise_xor.reduce(mix(m)).astype(np.int64)) if len(s) else 0)
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": n, "d1": d1, "d2": d2, "sig": sig})

    return sign


def _bander(bands: int, rows: int):
    def band(batches):
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), bands, rows)
            h = np.tile(salt, (len(pdf), 1))
            for r in range(rows):
                h = mix(h + sig[:, :, r])
            yield pd.DataFrame({"bucket": h.ravel().view(np.int64), "vid": np.repeat(pdf["vid"].to_numpy(), bands)})

    return band


def _pruner(threshold: float, miss: float, batch: int):
    def prune(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sa, sb = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint32).reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
            yield pdf.iloc[survivors(sa, sb, threshold, miss, batch)][["a", "b"]]

    return prune


def _sets(bands: int, rows: int, shingle: int):
    def sets(batches):
        a, b = hash_family(bands * rows)
        for pdf in batches:
            own = [shingle_set(t, shingle) for t in pdf["text"]]
            sig = [signature(s, a, b).tobytes() for s in own]
            yield pd.DataFrame({"vid": pdf["doc_id"], "sig": sig, "shingles": [s.tobytes() for s in own]})

    return sets


def _block_links(percent: int, miss: float, batch: int):
    """Links between different components in each block of sorted rows: pruned, then exact.

    All pairs of a block at distance 1, then 2 and so on are taken together over all the
    blocks at hand, so many small blocks cost little more than a large one.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), -1)
        head = np.ascontiguousarray(sig[:, :batch])
        vid, comp, chunk, c0, c1 = (pdf[c].to_numpy() for c in ("vid", "comp", "chunk", "c0", "c1"))
        bucket = pdf["bucket"].to_numpy()
        group = np.cumsum(np.r_[True, (bucket[1:] != bucket[:-1]) | (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])])
        found, least = [], least_matches(batch, percent / 100, miss)
        for d in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero((group[:-d] == group[d:]) & (comp[:-d] != comp[d:]) & ((chunk[:-d] != chunk[d:]) | (c0[:-d] == c1[:-d])))
            for at in range(0, len(i), 1 << 15):
                x = i[at : at + (1 << 15)]
                x = x[(head[x] == head[x + d]).sum(axis=1) >= least]
                x = x[survivors(sig[x], sig[x + d], percent / 100, miss, batch)]
                found.append(np.stack([x, x + d], axis=1))
        pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        ends = np.sort(vid[pairs], axis=1)
        _, first = np.unique(ends, axis=0, return_index=True)
        sets: dict[int, frozenset] = {}
        data, out = pdf["shingles"].to_numpy(), []
        for i, j in pairs[first]:
            x, y = (sets.get(k) or sets.setdefault(k, frozenset(np.frombuffer(data[k], dtype=np.uint64).tolist())) for k in (i, j))
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((vid[i], vid[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def links(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(held):
                continue
            last = held.iloc[-1]
            tail = ((held["bucket"] == last["bucket"]) & (held["c0"] == last["c0"]) & (held["c1"] == last["c1"])).to_numpy()
            if not tail.all():
                yield compare(held[~tail].reset_index(drop=True))
            held = held[tail].reset_index(drop=True)
        if held is not None and len(held):
            yield compare(held)

    return links


def _verifier(percent: int, shingle: int):
    def verify(batches):
        for pdf in batches:
            sets: dict[int, np.ndarray] = {}
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                for i, t in ((a, ta), (b, tb)):
                    if i not in sets:
                        sets[i] = shingle_set(t, shingle)
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return verify


def _ids(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")


def _exact(pairs: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The links among candidate pairs (a, b), confirmed on full shingle sets; materialized."""
    pairs = materialize(pairs.distinct(), "survivors")
    ids = _ids(pairs)
    texts = materialize(pick(docs.select("doc_id", "text"), "doc_id", ids), "texts")
    full = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    full = full.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialize(full.select("a", "b", "text_a", "text_b").mapInPandas(lean(_verifier(percent, shingle)), "a long, b long").distinct(), "links")
    discard(pairs, ids, texts)
    return links


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    n, some, different = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    return n == some == different


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, ...) -> one row a row: doc_id, n_shingles, component_id, kept; options as of grouped().

    Rows are linked by their own texts. component_id is the smallest doc_id of the rows that a row
    reaches, itself included (null if none of them has one); kept says that the doc_id is that one, or
    that the row is the first of a component without ids. Where doc_id is null or repeated, rows get numbers in
    their stored order to be told apart: rows that repeat a doc_id may have different texts.

    Null, empty or word-less texts: n_shingles 0, linked with nothing. Fewer words than a shingle: the
    whole sequence is the set. Texts of any length are read whole. An empty table gives no rows; other
    columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    if ids_are_keys(docs):
        return grouped(docs, **options)
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = grouped(rows.select(F.col("__row").alias("doc_id"), "text"), **options)
    named = found.select(F.col("doc_id").alias("__row"), "n_shingles", F.col("component_id").alias("c")).join(rows.select("__row", "doc_id"), "__row")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min("__row").alias("first"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("__row") == F.col("first")))
    return named.join(least, "c").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def grouped(
    docs: DataFrame, percent: int = 75, shingle: int = 5, bands: int = 40, rows: int = 5, miss: float = 1e-6, batch: int = 20
) -> DataFrame:
    """near_duplicates of docs(doc_id, text) whose ids are keys.

    1. Sign: bands x rows MinHash values of each document's distinct word shingles.
       Documents of equal sets form one class, which its smallest doc_id stands for.
       A pair at the threshold shares no band with probability (1 - 0.75^5)^40 = 2e-5.
    2. Star: each bucket's members against its smallest; Bayesian batches drop pairs
       whose posterior chance of reaching the threshold is below `miss`; the exact sets
       confirm the rest. Components of these links absorb large groups of copies.
    3. Rest: buckets that still hold several components are compared in full between
       components, in blocks of at most 2 x 256 members; buckets of equal membership
       count once. The same batches prune, exact sets that travel with the block's
       members confirm, and only links leave the block. Components are taken again.
    So every pair that shares a bucket is decided, without emitting a group's pairs. Rows of blocks grow
    with the square of the members of a bucket that are not linked yet (README).
    """
    small_batches(docs.sparkSession)
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    signed = materialize(docs.mapInPandas(lean(_signer(bands, rows, shingle)), "doc_id long, n int, d1 long, d2 long, sig binary"), "signed")
    classes = materialize(signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("vid")), "classes")
    reps = materialize(
        signed.where("n > 0")
        .join(classes, ["n", "d1", "d2"])
        .where("doc_id = vid")
        .select("vid", "sig", "n", "d1", "d2")
        .dropDuplicates(["vid", "n", "d1", "d2"])
        .select("vid", "sig"),
        "reps",
    )
    members = materialize(signed.select("doc_id", "n", "d1", "d2"), "members")
    discard(signed)

    banded = reps.mapInPandas(lean(_bander(bands, rows)), "bucket long, vid long")
    shared = banded.groupBy("bucket").agg(F.min("vid").alias("lo"), F.max("vid").alias("hi")).where("lo < hi").select("bucket", "lo")
    buckets = materialize(banded.join(shared, "bucket"), "buckets")
    star = materialize(buckets.where("vid <> lo").select(F.col("lo").alias("a"), F.col("vid").alias("b")).distinct(), "star")
    ids = _ids(star)
    sigs = pick(reps, "vid", ids)
    full = star.join(sigs.select(F.col("vid").alias("b"), F.col("sig").alias("sig_b")), "b")
    full = full.join(sigs.select(F.col("vid").alias("a"), F.col("sig").alias("sig_a")), "a")
    alive = full.mapInPandas(lean(_pruner(threshold, miss, batch)), "a long, b long")
    links = _exact(alive, docs, percent, shingle)
    first = components(links)

    held = buckets.select("bucket", "vid").join(first.withColumnRenamed("id", "vid"), "vid", "left")
    held = materialize(held.select("bucket", "vid", F.coalesce("component", "vid").alias("comp")), "held")
    mixed = held.groupBy("bucket").agg(
        F.count("*").alias("m"), F.min("vid").alias("lo"), F.bit_xor(F.xxhash64("vid")).alias("x"),
        F.min("comp").alias("c0"), F.max("comp").alias("c1"),
    )
    mixed = mixed.where("c0 < c1").groupBy("m", "lo", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    block = held.join(mixed, "bucket").withColumn("chunks", F.ceil(F.col("m") / BLOCK).cast("int"))
    block = block.withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int"))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = materialize(block.select("bucket", F.least("chunk", "other").alias("c0"), F.greatest("chunk", "other").alias("c1"), "vid", "comp", "chunk"), "blocks")
    ids2 = materialize(block.select(F.col("vid").alias("id")).distinct(), "ids")
    sets = pick(docs, "doc_id", ids2).mapInPandas(lean(_sets(bands, rows, shingle)), "vid long, sig binary, shingles binary")
    blocked = block.join(sets, "vid").repartition("bucket", "c0", "c1").sortWithinPartitions("bucket", "c0", "c1")
    more = materialize(blocked.mapInPandas(lean(_block_links(percent, miss, batch)), "a long, b long").distinct(), "links")
    comps = components(links.union(more)) if more.limit(1).count() else first
    discard(buckets, star, ids, held, block, ids2, reps, links, more)

    out = members.join(classes, ["n", "d1", "d2"], "left")
    out = out.join(comps.withColumnRenamed("id", "vid"), "vid", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "vid"))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
