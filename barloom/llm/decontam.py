"""Benchmark decontamination: size-partitioned MinHash containment, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, grams, lean, materialize, shingle_set, small_batches, words
from .minhash import hash_family, signature

#: Bytes of index that one pass over the documents searches; a larger benchmark is searched in several
#: passes, so what is sent stays bounded (but for an item that is larger itself).
BYTES_A_PASS = 64 << 20
HASHES = 48
#: Bytes of an item in the index besides its shingles: its values in the tables, and up to 128 flags a value.
_ITEM_BYTES = HASHES * (8 + 4 + 128)


class Index:
    """MinHash tables of one block of items, partitioned by set size, all in flat arrays.

    The class U holds items of U/2 < n <= U shingles. A document is cut into blocks of U/2
    shingles; windows of three consecutive blocks hold every passage of up to U shingles,
    so a window around a passage that has 3/4 of an item's shingles has Jaccard similarity
    of 0.375 / 1.625 = 0.23 or more with it. One equal value of the 48 makes a candidate: a
    miss has probability (1 - 0.23)^48 = 4e-6. All candidates are then decided exactly
    over the document's whole set, so longer or scattered copies count too.
    """

    def __init__(self, ids: list, sets: list[np.ndarray], signatures: np.ndarray, percent: int, shingle: int):
        self.percent, self.shingle, self.ids = percent, shingle, ids
        self.a, self.b = hash_family(HASHES)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        self.ends = np.cumsum(np.r_[0, n])
        self.flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        up = np.array([1 << math.ceil(math.log2(x)) for x in n.tolist()], dtype=np.int64)
        row = np.arange(HASHES, dtype=np.uint64)[None, :] << U64(32)
        self.classes = []
        for size in np.unique(up).tolist():
            members = np.flatnonzero(up == size)
            bits = min(24, max(16, math.ceil(math.log2(64 * len(members)))))
            sig = signatures[members]
            may = np.zeros((HASHES, 1 << bits), dtype=bool)
            for j in range(HASHES):
                may[j, sig[:, j] >> np.uint32(32 - bits)] = True
            key = (row | sig.astype(np.uint64)).ravel()
            order = np.argsort(key, kind="stable")
            self.classes.append((max(1, size // 2), bits, may, key[order], np.repeat(members, HASHES)[order].astype(np.int32)))

    def _set(self, m: int) -> np.ndarray:
        return self.flat[self.ends[m] : self.ends[m + 1]]

    def _minima(self, x: np.ndarray, width: int) -> np.ndarray:
        """The least value of each hash function in each block of `width` shingles."""
        step = width * max(1, 4096 // width)
        least = []
        for i in range(0, len(x), step):
            v = self.a[:, None] * x[None, i : i + step]
            v += self.b[:, None]
            least.append(np.minimum.reduceat(v, np.arange(0, v.shape[1], width), axis=1))
        return np.concatenate(least, axis=1)

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, its set size, shared shingles) of the items that the text contains."""
        if not text or not self.ids:
            return []
        h = words(text.encode("utf-8"))[0]
        g = grams(h, min(self.shingle, len(h))) if len(h) else h
        if not len(g):
            return []
        maybe: set[int] = set()
        x = (g >> U64(32)).astype(np.uint32)
        row = np.arange(HASHES)[:, None]
        m, width = None, 0
        for half, bits, may, keys, members in self.classes:
            if m is None:
                m = self._minima(x, half)
            elif half > width:  # blocks of a larger class are whole runs of a smaller one's
                m = np.minimum.reduceat(m, np.arange(0, m.shape[1], half // width), axis=1)
            width = half
            near = m.copy()
            np.minimum(near[:, 1:], m[:, :-1], out=near[:, 1:])
            np.minimum(near[:, :-1], m[:, 1:], out=near[:, :-1])
            j, at = np.divmod(np.flatnonzero(may.take((near >> np.uint32(32 - bits)) + (row << bits))), near.shape[1])
            if not len(j):
                continue
            key = np.unique(j.astype(np.uint64) << U64(32) | near[j, at].astype(np.uint64))
            for lo, hi in zip(np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")):
                maybe.update(members[lo:hi].tolist())
        if not maybe:
            return []
        whole, out = np.unique(g), []
        for m in sorted(maybe):
            s = self._set(m)
            both = len(np.intersect1d(whole, s, assume_unique=True))
            if 100 * both >= self.percent * len(s):
                out.append((self.ids[m], len(s), both))
        return out


def _sketches(shingle: int):
    """The shingles and MinHash values of each item that has any."""

    def sketch(batches):
        a, b = hash_family(HASHES)
        for pdf in batches:
            sets = [shingle_set(t, shingle) for t in pdf["text"]]
            out = pd.DataFrame({"item_id": pdf["item_id"].astype("Int64"), "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets], "sig": [signature(s, a, b).tobytes() for s in sets]})
            yield out[out["n"] > 0]

    return sketch


def _indexes(items: DataFrame, percent: int, shingle: int):
    """Broadcast indexes, each of a block of the items that is bounded in bytes.

    Executors make the shingles and the values; the driver gets a block at a time and sorts it.
    """
    small_batches(items.sparkSession)
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    known = materialize(items.mapInPandas(lean(_sketches(shingle)), "item_id long, n long, shingles binary, sig binary"), "sketches")
    size = known.agg(F.sum(8 * F.col("n") + _ITEM_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(size / BYTES_A_PASS))
    for i in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == i)
        rows = part.select("item_id", "shingles", "sig").collect()
        sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), dtype=np.uint32).reshape(len(rows), HASHES)
        yield spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], sets, sig, percent, shingle))
    discard(known)


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, n_item, n_shared, containment).

    One row for each document and item with 100 * shared >= percent * item set size, on sets
    of distinct lower-cased word shingles; a text of fewer words than a shingle is one
    shingle, so such an item is found in equal texts only. Null, empty and word-less texts
    match nothing; null ids are returned as they are; repeated rows return repeated rows.
    Documents are read once for each block of items and never shuffled.
    """
    out = None
    for sent in _indexes(items, percent, shingle):

        def search(batches, sent=sent):
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for hit in sent.value.search(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_item", "n_shared"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64", "n_item": "int64", "n_shared": "int64"})

        found = docs.select("doc_id", "text").mapInPandas(lean(search), "doc_id long, item_id long, n_item long, n_shared long")
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item.

    Rows with null, empty or word-less texts contain none; repeated rows are decided one by one, texts of
    any length as a whole; an empty table of items keeps all rows. If the items take several passes,
    what each pass keeps is written for the next.
    """
    passed = None
    for sent in _indexes(items, percent, shingle):

        def clean(batches, sent=sent):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not sent.value.search(t) for t in texts], type=pa.bool_()))

        docs = docs if passed is None else materialize(passed, "clean")
        passed = docs.mapInArrow(lean(clean), docs.schema)
    return passed
