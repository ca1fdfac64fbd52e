"""Order MinHash fingerprints of documents, in DataFrame expressions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal, lower_ascii, partitions, rank_in

#: Buckets of a signature (a power of two), units of a k-mer, code points of a unit at most.
BUCKETS, K, UNIT = 64, 3, 8
_SHIFT = 64 - (BUCKETS.bit_length() - 1)
#: Steps of the search for the first of equal values, together more places than an array has.
_STEPS = [1 << i for i in range(30, -1, -1)]
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def signature(text: Column) -> Column:
    """The Order MinHash signature: an array of 64 values, empty for texts without words.

    A text's units are its words, ASCII-lower-cased and cut after 8 code points. Each run of
    3 units (or, in a shorter text, all of them) is a k-mer, numbered by its occurrence. One
    64-bit hash of (k-mer, occurrence) lays them on a circle that 64 marks divide evenly (the
    one-permutation form of 64 hash functions, sparse buckets filled by rotation): each mark
    draws the first two of ALL k-mers at or after it, however short the text. The two are
    put back into text order and hashed together, so two texts agree at a mark only if the
    minima and their order agree, and moves and edits both count. Places are 32-bit, so texts
    of any length that Spark can hold keep their order.
    """
    units = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0))

    def kmers(u: Column) -> Column:
        n = F.size(u)
        many = F.transform(
            F.slice(u, 1, F.greatest(n - (K - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(u, i + j) for j in range(1, K)]),
        )
        return F.when(n >= K, many).when(n > 0, F.array(F.xxhash64(F.array_join(u, " ")))).otherwise(F.array().cast("array<bigint>"))

    def placed(h: Column, p: Column) -> Column:
        return F.struct(h.alias("h"), p.alias("p"))

    def numbered(s: Column) -> Column:
        """The hash of each k-mer with its occurrence; `s` is sorted, so equal ones are neighbours in text order."""

        def same(x: Column, at: Column) -> Column:
            return F.get(s, at)["h"] == x["h"]

        def occurrence(x: Column, i: Column) -> Column:
            back = F.aggregate(
                F.array(*[F.lit(d) for d in _STEPS]),
                F.lit(0),
                lambda acc, d: F.when((d <= i - acc) & same(x, i - acc - d), acc + d).otherwise(acc),
            )
            return F.when((i > 0) & same(x, i - 1), back).otherwise(F.lit(0))

        return F.transform(s, lambda x, i: placed(F.xxhash64(x["h"], occurrence(x, i)), x["p"]))

    def circle(h: Column) -> Column:
        """All k-mers by their hash; only texts that repeat one need the sort that numbers them."""
        once = F.transform(h, lambda x, i: placed(F.xxhash64(x, F.lit(0)), i))
        again = _with(F.sort_array(F.transform(h, placed)), numbered)
        return F.sort_array(F.when(F.size(F.array_distinct(h)) == F.size(h), once).otherwise(again))

    def bucket(x: Column) -> Column:
        return F.shiftright(x["h"], _SHIFT).cast("int") + BUCKETS // 2

    def first_two(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < 2) | (bucket(F.get(s, i - 2)) != bucket(x)))

    def drawn(m: Column) -> Column:
        """The value of each mark; `m` has the first two of each bucket, so a neighbour in it is one on the circle."""
        n = F.size(m)

        def value(x: Column, i: Column) -> Column:
            y = F.get(m, (i + 1) % n)
            two = F.when(x["p"] < y["p"], F.xxhash64(x["h"], y["h"])).otherwise(F.xxhash64(y["h"], x["h"]))
            return F.when(n > 1, two).otherwise(F.xxhash64(x["h"]))

        def marks(x: Column, i: Column) -> Column:
            before = F.when(i > 0, bucket(F.get(m, i - 1))).otherwise(F.lit(-1))
            return F.when(bucket(x) > before, F.array_repeat(value(x, i), bucket(x) - before)).otherwise(F.array().cast("array<bigint>"))

        last = F.array_repeat(value(F.get(m, F.lit(0)), F.lit(0)), F.lit(BUCKETS - 1) - bucket(F.get(m, n - 1)))
        return F.when(n > 0, F.concat(F.flatten(F.transform(m, marks)), last)).otherwise(F.array().cast("array<bigint>"))

    return _with(_with(_with(_with(units, kmers), circle), first_two), drawn)


def _with(value: Column, use) -> Column:
    """use(value), with value computed once: Catalyst does not share it across lambdas."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def likeness(a: Column, b: Column) -> Column:
    """The share of the marks at which two signatures agree; 1 if both are empty, 0 if one is."""
    same = F.size(F.filter(a, lambda x, i: x == F.get(b, i)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.lit(BUCKETS)))


def text_form(sig: Column) -> Column:
    """A signature as text: sixteen hex digits for each mark."""
    return F.array_join(F.transform(sig, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def _cuts(base: DataFrame, blocks: int) -> list[tuple[int, int]]:
    """Keys (i, t) that cut the rows into about `blocks` even blocks, ascending.

    Approximate quantiles of the ids; an id that is several of them holds many rows, which
    quantiles of their texts' hashes cut further.
    """
    found = base.agg(F.percentile_approx("i", [x / blocks for x in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    often = {i: n for i, n in Counter(found or []).items() if n > 1}
    cuts = {(i, _MOST) for i in found or []}
    if often:
        hot = base.where(F.col("i").isin(list(often))).groupBy("i").agg(F.percentile_approx("t", [x / blocks for x in range(1, blocks)], 10_000).alias("t"))
        cuts |= {(r["i"], t) for r in hot.collect() for t in r["t"]}
    return sorted(cuts)


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 2) code points of a text give way to the first
    as many (or all) of the next document in descending doc_id; the first follows the last.
    Nulls are last and ties follow the texts' hashes, then the texts.

    Order without one global window: approximate quantiles of doc_id (of an id that many
    rows share or lack, of the texts' hashes too) cut the rows into blocks, found by binary
    search; a block is sorted in one task. The first row of each block is also sent, once,
    to the block before it, so a text is shuffled once. Signatures are computed once a
    text, before that.

    Null texts count as empty; a single document is its own next; very long texts are read
    whole; extra columns are ignored; an empty table gives no rows.
    """
    blocks = blocks or 4 * partitions(docs.sparkSession)
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ident.alias("i"))
    base = base.withColumn("t", F.xxhash64("text"))
    cuts = _cuts(base, blocks)
    plain = all(t == _MOST for _, t in cuts)  # then the texts' hashes do not matter, and need not be read
    known = literal([i for i, _ in cuts], "bigint") if plain else literal([{"i": i, "t": t} for i, t in cuts], "struct<i:bigint,t:bigint>")
    key = F.col("i") if plain else F.struct("i", "t")
    # blocks descend as ids do: the number of cuts at or above a key
    base = base.withColumn("block", F.lit(len(cuts)) - rank_in(known, key, len(cuts), below=True))
    found = base.withColumn("part", F.spark_partition_id()).groupBy("block").agg(F.max("i").alias("i"), F.collect_set("part").alias("parts")).collect()
    tops = {r["block"]: r["i"] for r in found} or {0: 0}
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if len({p for r in found for p in r["parts"]}) < min(cores, blocks):  # a scan of few parts would leave cores idle
        base = base.repartition(cores, "i", "t")
    used = sorted(tops)
    before = dict(zip(used, [used[-1], *used[:-1]]))
    top, prior = (F.get(literal([x.get(b, 0) for b in range(len(cuts) + 1)], "bigint"), F.col("block")) for x in (tops, before))
    guests = base.where(F.col("i") == top).groupBy("block").agg(F.max(F.struct("t", "text")).alias("x"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), F.col("x.text").alias("text"), F.lit(_LEAST).alias("i"), F.col("x.t").alias("t"), prior.cast("int").alias("block"), F.lit(1).alias("guest"))
    rows = base.withColumns({"doc_id": F.col("doc_id").cast("long"), "guest": F.lit(0)}).unionByName(guests).withColumn("sig", signature(F.col("text")))
    rows = rows.repartition(partitions(docs.sparkSession), "block")  # a number: the next signatures cost more than their bytes say
    order = Window.partitionBy("block").orderBy("guest", F.desc("i"), F.desc("t"), F.desc("text"))
    rows = rows.withColumn("next", F.lead(F.struct("text", "sig")).over(order)).where("guest = 0")
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long"))
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sig", F.col("next.sig").alias("next_sig"), edited.alias("edited"))
    rows = rows.withColumn("edited_sig", signature(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_form(F.col("sig")).alias("fingerprint"),
        text_form(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
