"""Repeated passages by sparse suffix arrays over minimiser positions."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U64, discard, grams, lean, materialize, mix, partitions, runs, small_batches, words


def minimisers(h: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the least k-word hash of each w consecutive ones, and all the hashes."""
    g = grams(h, k)
    if len(g) < w:
        return np.empty(0, dtype=np.int64), g
    key, found = mix(g), []
    for i in range(0, len(g) - w + 1, 1 << 15):
        part = key[i : i + (1 << 15) + w - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, w)
        found.append(np.unique(view.argmin(axis=1) + np.arange(len(view))) + i)
    return np.unique(np.concatenate(found)), g


def _select(k: int, w: int):
    def select(batches):
        for pdf in batches:
            kmer, doc, at = [], [], []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                p, g = minimisers(words(t.encode("utf-8"))[0], k, w)
                kmer.append(g[p].view(np.int64))
                doc.append(np.full(len(p), d))
                at.append(p)
            if kmer:
                yield pd.DataFrame({"kmer": np.concatenate(kmer), "doc_id": np.concatenate(doc).astype("int64"), "p": np.concatenate(at).astype("int32")})

    return select


def _contexts(k: int, left: int, right: int):
    """The words around each candidate position, as 32-bit hashes, nearest first.

    The candidates of a doc_id may stem from several texts; each text takes those it is long
    enough for, and `t`, a hash of the text, keeps them apart.
    """

    def contexts(batches):
        for pdf in batches:
            rows = []
            for d, text, ps in zip(pdf["doc_id"], pdf["text"], pdf["ps"]):
                h = words(text.encode("utf-8"))[0]
                short = (h >> U64(32)).astype(">u4")
                g = grams(h, k).view(np.int64)
                ps = np.unique(ps)
                ps = ps[ps < len(g)]
                lo, hi = np.maximum(0, ps - left), np.minimum(len(h), ps + right)
                r, l, t = (runs(h, a, b).view(np.int64).tolist() for a, b in ((ps, hi), (lo, ps), (np.array([0]), np.array([len(h)]))))
                back = short[::-1]
                for p, i, a, b, x, y in zip(ps.tolist(), g[ps].tolist(), lo.tolist(), hi.tolist(), r, l):
                    rows.append((i, x, y, p - a, b - p, short[p:b].tobytes(), back[len(h) - p : len(h) - a].tobytes(), d, t[0], p))
            yield pd.DataFrame(rows, columns=["kmer", "r", "l", "nl", "nr", "rctx", "lctx", "doc_id", "t", "p"])

    return contexts


_GROUP = ["kmer", "r", "l", "nl", "nr"]
_EDGE = "kmer long, r long, l long, nl int, nr int, rctx binary, lctx binary, lo long, hi long"
#: What a row says: a match; the longest match on the sorted side; the first and last row of a
#: task, and the rows beside its first and last run; a row of the first run, and of the last.
_PAIR, _BOUND, _FIRST, _LAST, _AFTER, _BEFORE, _HEAD, _TAIL = range(8)
_MATCH = f"{_EDGE}, ml int, mr int, kind int, part int"


def _matrix(col, n, width):
    """Rows of 32-bit hashes from binary cells of up to 4 * width bytes, and which cells exist."""
    data = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in col), dtype=">u4").reshape(len(col), width)
    return data.astype(np.uint32), np.arange(width)[None, :] < np.asarray(n)[:, None]


def _run(equal: np.ndarray) -> np.ndarray:
    """How many leading cells of each row are true."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """Where runs start: rows of one single document that follow each other with one k-mer."""
    lo, hi, kmer = (pdf[c].to_numpy() for c in ("lo", "hi", "kmer"))
    return np.flatnonzero(np.r_[True, (kmer[1:] != kmer[:-1]) | (lo[1:] != lo[:-1]) | (lo[1:] != hi[1:]) | (lo[:-1] != hi[:-1])])


def _compare(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray, least: int, left: int, right: int, by_right: bool) -> pd.DataFrame:
    """Rows i and j of pdf, extended both ways: matches of `least` words, and bounds.

    A row's bound is its longest match here on the sorted side; it is left out where the other side
    matches as far as it goes, or where no match can be long enough.
    """
    n = len(pdf)
    R, rv = _matrix(pdf["rctx"], pdf["nr"], right)
    L, lv = _matrix(pdf["lctx"], pdf["nl"], left)
    lo, hi, kmer, nl, nr = (pdf[c].to_numpy() for c in ("lo", "hi", "kmer", "nl", "nr"))
    ok = kmer[i] == kmer[j]
    i, j = i[ok], j[ok]
    mr = _run((R[i] == R[j]) & rv[i] & rv[j])
    ml = _run((L[i] == L[j]) & lv[i] & lv[j])
    far = np.full(n, -1)
    for x in (i, j):
        np.maximum.at(far, x, mr * 1024 + ml if by_right else ml * 1024 + mr)
    most, other = far // 1024, far % 1024
    rest = nl if by_right else nr
    bound = np.flatnonzero((lo == hi) & (most > 0) & (other < rest) & (most + rest >= least))
    good = mr + ml >= least
    i, j, ml, mr = i[good], j[good], ml[good], mr[good]
    out = pdf.iloc[np.r_[i, j, bound]].copy()
    most, other = most[bound], other[bound]
    out["ml"] = np.r_[ml, ml, other if by_right else most].astype("int32")
    out["mr"] = np.r_[mr, mr, most if by_right else other].astype("int32")
    out["kind"] = np.r_[np.full(2 * len(i), _PAIR), np.full(len(bound), _BOUND)].astype("int32")
    out["rctx"], out["lctx"] = None, None
    return out


def _neighbours(least: int, left: int, right: int, by_right: bool):
    """Compares rows that are sorted by context with their neighbours, one stream a task.

    Each row meets the last row before its run and the first one after it, so its longest match on
    the sorted side with another document is among them. A task holds one run at a time: the
    places of one k-mer in one document. Its first and last run, which the tasks beside it
    complete, are returned, and the few rows that say where they end.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, start = len(pdf), _starts(pdf)
        ends = np.r_[start[1:], n]
        run = np.repeat(np.arange(len(start)), ends - start)
        inner = np.flatnonzero(np.arange(n) < ends[run] - 1)  # the last row of a run is met by the next run
        i = np.r_[np.arange(n), inner]
        j = np.r_[start[run] - 1, ends[run[inner]]]
        ok = (j >= 0) & (j < n)
        return _compare(pdf, i[ok], j[ok], least, left, right, by_right).assign(part=np.int32(0))

    def neighbours(batches):
        from pyspark import TaskContext

        part = np.int32(TaskContext.get().partitionId())
        said = lambda rows, kind: rows.assign(ml=np.int32(-1), mr=np.int32(-1), kind=np.int32(kind), part=part)
        held: list[pd.DataFrame] = []  # the last run so far, with the row before it
        open_, first = False, True  # whether held has rows not compared yet; whether the first run goes on
        for pdf in batches:
            if not len(pdf):
                continue
            if held and len(_starts(pd.concat([held[-1].iloc[-1:], pdf]))) == 1:
                held.append(pdf)
                open_ = True
                continue
            if not held:
                yield said(pdf.iloc[:1], _FIRST)
            both = pd.concat([*held, pdf], ignore_index=True)
            yield compare(both)
            start, open_ = _starts(both), False
            if first and len(start) > 1:
                first = False
                yield said(both.iloc[: start[1]], _HEAD)
                yield said(both.iloc[start[1] : start[1] + 1], _AFTER)
            held = [both.iloc[max(0, start[-1] - 1) :]]
        if not held:
            return
        both = pd.concat(held, ignore_index=True)
        if open_:
            yield compare(both)
        at = _starts(both)[-1]
        if first:
            yield said(both, _HEAD)
        else:
            yield said(both.iloc[at - 1 : at], _BEFORE)
        yield said(both.iloc[at:], _TAIL)
        yield said(both.iloc[-1:], _LAST)

    return neighbours


def _same_run(x, y) -> bool:
    return x["kmer"] == y["kmer"] and x["lo"] == x["hi"] == y["lo"] == y["hi"]


def _beside(ends: list, keys: list[str]) -> tuple[dict, dict]:
    """For each task the row that its first run meets before it, and that its last run meets after it.

    From four rows a task at most; tasks are ordered by their first rows.
    """
    tasks: dict[int, dict] = {}
    for r in ends:
        tasks.setdefault(r["part"], {})[r["kind"]] = r
    order = sorted(tasks, key=lambda p: [bytes(x) if isinstance(x, bytearray) else x for x in (tasks[p][_FIRST][k] for k in keys)])

    def seek(parts: list[int], mine: int, end: int, beyond: int) -> dict:
        out: dict = {}
        for i, p in enumerate(parts):
            own = tasks[p][mine]
            for q in reversed(parts[:i]):
                if not _same_run(own, tasks[q][end]):
                    out[p] = tasks[q][end]
                elif beyond in tasks[q]:
                    out[p] = tasks[q][beyond]
                else:
                    continue
                break
        return out

    return seek(order, _FIRST, _LAST, _BEFORE), seek(order[::-1], _LAST, _FIRST, _AFTER)


def _across(least: int, left: int, right: int, by_right: bool, sent):
    """Compares the rows of tasks' first and last runs with the row beyond the task's edge."""

    def across(batches):
        before, after = sent.value
        for pdf in batches:
            beyond = [(before if k == _HEAD else after).get(p) for k, p in zip(pdf["kind"], pdf["part"])]
            i = np.flatnonzero([x is not None for x in beyond])
            if not len(i):
                continue
            names = [c for c in pdf.columns if c not in ("ml", "mr", "kind", "part")]
            rows, others = pdf[names].iloc[i], pd.DataFrame([beyond[x] for x in i], columns=names)
            both = pd.concat([rows, others], ignore_index=True)
            n = np.arange(len(i))
            yield _compare(both, n, n + len(i), least, left, right, by_right).assign(part=np.int32(0))

    return across


def _matches(groups: DataFrame, keys: list[str], least: int, left: int, right: int, by_right: bool) -> list[DataFrame]:
    """The matches and bounds (_MATCH) of groups in the order of keys, within tasks and across them."""
    spark = groups.sparkSession
    rows = groups.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    own = materialize(rows.mapInPandas(lean(_neighbours(least, left, right, by_right)), _MATCH), "matches")
    ends = own.where(F.col("kind").between(_FIRST, _BEFORE)).collect()  # four rows a task
    names = [c for c in groups.columns]
    plain = [{c: bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in [*names, "kind", "part"]} for r in ends]
    beside = tuple({p: tuple(r[c] for c in names) for p, r in x.items()} for x in _beside(plain, keys))
    edge = own.where(F.col("kind").isin(_HEAD, _TAIL)).select(*names, "ml", "mr", "kind", "part")
    if not any(beside):
        return [own]
    edge = edge.repartition(partitions(spark), F.xxhash64("part", "kind", "rctx", "lctx"))
    return [own, materialize(edge.mapInPandas(lean(_across(least, left, right, by_right, spark.sparkContext.broadcast(beside))), _MATCH), "edges")]


def _hidden(groups: DataFrame, right: DataFrame, left: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Matches that neither order shows: (_GROUP, ml, mr) of single passages of `least` words; and tables to discard.

    A row whose longest matches to the right and to the left are with different rows may
    have a shorter one with a third, long enough on both sides together. Such rows are few;
    the passages of `least` words around them are compared with those of all rows of their k-mer.
    """
    right = right.groupBy(*_GROUP).agg(F.max(F.struct("mr", "ml")).alias("far_r"))
    left = left.groupBy(*_GROUP).agg(F.max(F.struct("ml", "mr")).alias("far_l"))
    open_ = right.join(left, _GROUP).where((F.col("far_r.mr") + F.col("far_l.ml") >= least) & (F.col("far_r.ml") < F.col("far_l.ml")) & (F.col("far_l.mr") < F.col("far_r.mr")))
    open_ = materialize(open_.select(*_GROUP, (F.lit(least) - F.col("far_r.mr")).alias("l0"), F.col("far_l.ml").alias("l1")), "open")

    def passages(rows: DataFrame) -> DataFrame:
        first, last = F.greatest("l0", F.lit(least) - F.col("nr")), F.least("l1", "nl")
        rows = rows.where(first <= last).withColumn("ml", F.explode(F.sequence(first, last)))
        x, y = F.substring("rctx", F.lit(1), 4 * (F.lit(least) - F.col("ml"))), F.substring("lctx", F.lit(1), 4 * F.col("ml"))
        return rows.select(*_GROUP, "ml", F.xxhash64(x).alias("x"), F.xxhash64(y).alias("y"), "lo", "hi")

    spots = open_.groupBy("kmer").agg(F.min("l0").alias("l0"), F.max("l1").alias("l1"))
    spots = materialize(spots, "spots")
    few = spots.count() <= BROADCAST_IDS
    near = materialize(groups.join(F.broadcast(spots) if few else spots, "kmer"), "near")
    seen = passages(near).groupBy("kmer", "ml", "x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mine = passages(near.drop("l0", "l1").join(open_, _GROUP)).drop("lo", "hi")
    found = mine.join(seen.where("lo < hi").drop("lo", "hi"), ["kmer", "ml", "x", "y"])
    return found.select(*_GROUP, "ml", (F.lit(least) - F.col("ml")).alias("mr")), [open_, spots, near]


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 10, within: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start_word, end_word, n_words) of repeated passages.

    Maximal runs of words, each of which lies in a passage of at least `least` words that
    (ASCII-lower-cased, white space aside) also occurs in another document; with `within`
    also at another place of the same one. Nothing is dropped, the first copy is reported
    too.

    1. Suffixes are kept only at minimiser positions: the least k-word hash of every
       least - k consecutive ones, so a passage of `least` words holds one at the same place
       in each copy.
    2. Suffixes whose first k words occur nowhere else are dropped. The others get their
       context: the words up to `least` to the right, least - k to the left.
    3. Equal contexts are grouped (combined map-side, so a hot passage is one row), then all
       are sorted by what follows and again by what precedes, range-partitioned over the
       full key, so that even one hot start spreads over tasks; neighbours are compared and
       their match extended both ways. The runs at tasks' edges are compared afterwards, in
       parallel, with the row beyond the edge (four rows a task tell the driver which).
       Rows whose longest matches to both sides are with different rows are checked exactly.
    4. Matches return to all members of their group and are merged by document.

    Null, empty or short texts and rows without doc_id report nothing. Rows that repeat a doc_id
    count as one document, so what only they share is no repeat; where their texts differ, the
    passages of each text are reported, equal ones once. A very long text is read whole by one
    task. An empty table returns no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    left, right = least - k, least
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    kept = materialize(docs.mapInPandas(lean(_select(k, least - k)), "kmer long, doc_id long, p int"), "suffixes")
    known = kept.groupBy("kmer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("m"))
    known = materialize(known.where("m > 1" if within else "lo < hi").select("kmer"), "repeated")  # a side AQE can split
    places = materialize(kept.join(known, "kmer").groupBy("doc_id").agg(F.collect_set("p").alias("ps")), "places")
    schema = "kmer long, r long, l long, nl int, nr int, rctx binary, lctx binary, doc_id long, t long, p int"
    found = materialize(docs.join(places, "doc_id").mapInPandas(lean(_contexts(k, left, right)), schema), "contexts")
    discard(kept, places, known)

    groups = found.groupBy(*_GROUP).agg(
        F.any_value("rctx").alias("rctx"), F.any_value("lctx").alias("lctx"), F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"), F.count("*").alias("m"),
    )
    if within:  # each place stands as a document of its own
        groups = groups.withColumn("lo", F.xxhash64(*_GROUP)).withColumn("hi", F.col("lo") + F.when(F.col("m") > 1, 1).otherwise(0))
    groups = materialize(groups.drop("m"), "groups")
    whole = groups.where((F.col("lo") < F.col("hi")) & (F.col("nl") + F.col("nr") >= least))
    matches = [whole.select(*_GROUP, F.col("nl").alias("ml"), F.col("nr").alias("mr"))]
    compared, bounds = [], []
    for by_right, keys in ((True, ["kmer", "rctx", "lctx", "lo"]), (False, ["kmer", "lctx", "rctx", "lo"])):
        tables = _matches(groups, keys, least, left, right, by_right)
        compared += tables
        both = functools.reduce(DataFrame.union, tables).select(*_GROUP, "ml", "mr", "kind")
        matches.append(both.where(F.col("kind") == _PAIR).drop("kind"))
        bounds.append(both.where(F.col("kind") == _BOUND).drop("kind"))
    hidden, own = _hidden(groups, *bounds, least)
    union = functools.reduce(DataFrame.union, [*matches, hidden])
    # a table of its own: a context that many rows share can then be split where they join
    extents = materialize(union.groupBy(*_GROUP).agg(F.collect_set(F.struct("ml", "mr")).alias("extents")), "extents")
    spans = found.select(*_GROUP, "doc_id", "t", "p").join(extents, _GROUP).select("doc_id", "t", "p", F.explode("extents").alias("e"))
    spans = spans.select("doc_id", "t", (F.col("p") - F.col("e.ml")).alias("s"), (F.col("p") + F.col("e.mr")).alias("e")).distinct()
    order = Window.partitionBy("doc_id", "t").orderBy("s", "e")
    spans = spans.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(order))
    out = spans.groupBy("doc_id", "t", "island").agg(F.min("s").cast("long").alias("start_word"), F.max("e").cast("long").alias("end_word"))
    out = out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
    out = materialize(out.dropDuplicates(["doc_id", "start_word", "end_word"]), "passages")
    discard(found, groups, extents, *own, *compared)
    return out
