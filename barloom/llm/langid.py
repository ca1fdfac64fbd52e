"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, lean, materialize, mix, release, small_batches

ORDER = 5
#: The bound of the labelled sample that is fitted: documents a language, drawn by a hash.
DOCS_A_LANGUAGE = 2_000
#: The most n-grams of each length in a model; a language over its share leaves out the rarest.
MAX_NGRAMS = 250_000
#: Nats a character beyond what calibration texts show that a text may have, where one language alone is learned.
MARGIN = 0.5
#: The lengths, in characters, at which the limits of rejection are calibrated; others lie between them.
LENGTHS = (4, 8, 16, 32, 64, 128, 256, 512)
#: Characters of a piece that has its own best language when a text is looked at again.
PIECE = 128
#: Fewer calibration texts of a length give way to those of all languages.
_FEW = 100
_MARK = re.compile(r"[A-Za-z0-9_+/=-]{8,}")
#: Characters scored at once.
_BLOCK = 1 << 18
_P = U64(0x9E3779B97F4A7C15)


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a combining mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], dtype=np.uint8)


def codes(text: str) -> np.ndarray:
    """Lower-cased letters and combining marks as code points; each run of others is one 0; all 0 without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[c]
    if not len(c) or not (kind == 2).any():
        return np.zeros(min(1, len(c)), dtype=np.uint32)
    c = np.where(kind > 0, c, 0)
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]


def unmarked(text: str) -> str:
    """The text without identifiers, keys and the like: runs of 8 characters or more with both digits and letters."""
    return _MARK.sub(lambda m: " " if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) else m[0], text)


def keys(c: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order: the hash of the n characters that end at each place of c[order-1:]."""
    out, n = [], len(c) - order + 1
    with np.errstate(over="ignore"):
        h = np.full(n, 0, dtype=np.uint64)
        x = c.astype(np.uint64) + U64(1)
        power = U64(1)
        for k in range(order):  # the k-th character from the right
            h = h + x[order - 1 - k : order - 1 - k + n] * power
            power = power * _P
            out.append(mix(h + U64(k + 1)))
    return out


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """The same hash for n-grams as rows of code points."""
    with np.errstate(over="ignore"):
        h, power = np.zeros(len(grams), dtype=np.uint64), U64(1)
        for k in range(grams.shape[1]):
            h = h + (grams[:, grams.shape[1] - 1 - k].astype(np.uint64) + U64(1)) * power
            power = power * _P
        return mix(h + U64(grams.shape[1]))


class Table:
    """A sorted array of hashes, with rows of values and an index over the leading bits."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], np.ascontiguousarray(value[order], dtype=np.float32)
        self.shift = U64(64 - max(1, math.ceil(math.log2(2 * len(key) + 2))))
        top = (self.key >> self.shift).astype(np.int64)
        self.start = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if absent."""
        top = (key >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(key), -1, dtype=np.int32)
        live = np.flatnonzero(at < end)
        at, end, key = at[live], end[live], key[live]
        while len(live):
            known = self.key[at]
            hit = known == key
            out[live[hit]] = at[hit]
            at = at + 1
            go = ~hit & (known < key) & (at < end)
            live, at, end, key = live[go], at[go], end[go], key[go]
        return out


class Model:
    """Interpolated Kneser-Ney character models of all languages over one set of n-grams.

    `levels` has, for every length k up to `order`, n-grams as rows of code points, the places of their
    languages in `langs`, their counts (of the highest order; lower ones have continuation counts: how many
    different characters precede) and the sums of the counts of their contexts; `discounts` has a discount
    for each (k, language). All are of the full counts; n-grams left out give what they had, undiscounted, to
    their context's lower orders, so probabilities still sum to one. For each n-gram that any
    language has, `prob[k]` holds the log probability of its last character in every
    language, interpolation done; `back[k]` the log of a context's share for lower orders.
    """

    def __init__(self, levels: dict, langs: list[str], discounts: dict, order: int = ORDER):
        self.order, self.langs = order, langs
        L = len(langs)
        self.alphabet = len(np.unique(levels[1][0])) + 1 if levels else 1
        self.prob, self.back = {}, {}
        for k in range(1, order + 1):
            none = np.empty(0)
            grams, lang, n, total = levels.get(k, (np.empty((0, k), dtype=np.uint32), none.astype(np.int64), none, none))
            d = np.array([discounts.get((k, x), 0.5) for x in [*langs, ""]])[lang]
            part = (n - d) / total
            key, ctx = gram_keys(grams), gram_keys(grams[:, :-1]) if k > 1 else np.zeros(len(grams), dtype=np.uint64)
            union, first, at = np.unique(key, return_index=True, return_inverse=True)
            contexts, c_at = np.unique(ctx, return_inverse=True)
            share, own = np.ones((len(contexts), L)), np.zeros((len(union), L))
            np.subtract.at(share, (c_at, lang), part)
            own[at, lang] = part
            lower = np.exp(self._log(grams[first, 1:])) if k > 1 else np.full((len(union), L), 1.0 / self.alphabet)
            p = own + share[c_at[first]] * lower
            self.prob[k] = Table(union, np.log(p))
            self.back[k] = Table(contexts, np.log(np.maximum(share, 1e-9)))
        #: By language, the most nats a character that a text of each of LENGTHS may have.
        self.limit: dict[str, np.ndarray] = {}

    def _log(self, grams: np.ndarray) -> np.ndarray:
        """The log probability of the last character of n-grams (rows of code points) in every language."""
        out, live = np.zeros((len(grams), len(self.langs))), np.arange(len(grams))
        for k in range(grams.shape[1], 0, -1):
            at = self.prob[k].find(gram_keys(grams[live, -k:]))
            out[live[at >= 0]] += self.prob[k].value[at[at >= 0]]
            live = live[at < 0]
            at = self.back[k].find(gram_keys(grams[live, -k:-1]) if k > 1 else np.zeros(len(live), dtype=np.uint64))
            out[live[at >= 0]] += self.back[k].value[at[at >= 0]]
        out[live] -= math.log(self.alphabet)
        return out

    def _block(self, c: np.ndarray) -> np.ndarray:
        ks = keys(c, self.order)
        n, L = len(ks[0]), len(self.langs)
        out = np.zeros((n, L), dtype=np.float32)
        live = np.arange(n)
        before = keys(c[:-1], self.order - 1) if self.order > 1 else []
        for k in range(self.order, 0, -1):
            at = self.prob[k].find(ks[k - 1][live])
            hit = at >= 0
            out[live[hit]] += self.prob[k].value[at[hit]]
            live = live[~hit]
            if not len(live):
                return out
            ctx = before[k - 2][live] if k > 1 else np.zeros(len(live), dtype=np.uint64)
            at = self.back[k].find(ctx)
            seen = at >= 0
            out[live[seen]] += self.back[k].value[at[seen]]
        out[live] -= math.log(self.alphabet)
        return out

    def entropies(self, text: str | None) -> tuple[int, np.ndarray | None]:
        """How many characters were scored, and the nats a character in every language."""
        c = codes(text) if text else np.empty(0, dtype=np.uint32)
        if not c.any() or not self.langs:
            return 0, None
        c = np.r_[np.zeros(self.order, dtype=np.uint32), c[1:] if c[0] == 0 else c]
        total, n = np.zeros(len(self.langs)), len(c) - self.order
        for i in range(1, n + 1, _BLOCK):
            total -= self._block(c[i : i + _BLOCK + self.order - 1]).sum(axis=0, dtype=np.float64)
        return n, total / n

    def pieces(self, text: str, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The characters of each piece of the text (of its first `most` characters), and their nats in every language."""
        c = codes(text)
        if not c.any():
            return np.empty(0, dtype=np.int64), np.empty((0, len(self.langs)))
        c = np.r_[np.zeros(self.order, dtype=np.uint32), c[1:] if c[0] == 0 else c][: most and most + self.order]
        n, sums = len(c) - self.order, []
        for i in range(1, n + 1, _BLOCK):
            b = self._block(c[i : i + _BLOCK + self.order - 1])
            sums.append(-np.add.reduceat(b, np.arange(0, len(b), PIECE), axis=0, dtype=np.float64))
        return np.diff(np.r_[np.arange(0, n, PIECE), n]), np.concatenate(sums)

    def fits(self, text: str, lang: str, n: int, h: float) -> bool:
        """Whether a text of n characters, with h nats each in lang, keeps lang's limit for its length.

        A text above it gets a second look: identifiers are left out (where a third of the
        text or more remains), and each piece counts in the language it fits best, so keys
        in a short text, or a passage in another learned language, do not reject it.
        """
        if lang not in self.limit:
            return True
        if h <= self._most(lang, n):
            return True
        size, nats = self.pieces(unmarked(text))
        left = int(size.sum())
        return left > 0 and 3 * left >= n and bool(nats.min(axis=1).sum() / left <= self._most(lang, left))

    def _most(self, lang: str, n: int) -> float:
        return float(np.interp(math.log(n), np.log(LENGTHS), self.limit[lang]))

    def calibrate(self, known: pd.DataFrame, miss: float) -> None:
        """Sets the limits from known(lang, length, own, rest): nats of texts of each length.

        `own` has a text's nats with all languages at hand, `rest` without its own one, as
        if that had not been learned. The limit of a language and length lies half way
        between what 99 of 100 of its own texts keep and what 95 of 100 texts of the nearest
        language left out exceed, but never below what all but a share of 2 x `miss` of its own texts keep:
        where both overlap, as in short texts, its own texts stay. With one language there is no
        rest: MARGIN is added. Languages with few texts take the spread of all.
        """
        known = known[known["length"].isin(LENGTHS)]
        for lang in known["lang"].unique():
            out: list[float] = []
            for length in LENGTHS:
                every = known[known["length"] == length]
                mine = every.loc[every["lang"] == lang, "own"]
                if not len(mine):  # no text is so long
                    out.append(out[-1] if out else math.inf)
                    continue
                middle = every.groupby("lang")["own"].transform("median")
                spread = mine - mine.median() if len(mine) >= _FEW else every["own"] - middle
                keep, most = (float(mine.median() + spread.quantile(q)) for q in (0.99, 1 - 2 * miss))
                rest = every.dropna(subset=["rest"]).groupby("lang")["rest"].quantile(0.05).min()
                out.append(most + MARGIN if math.isnan(rest) else max(most, (keep + rest) / 2))
            self.limit[lang] = np.array(out)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, nats a character, and whether the model accepts the text.

        The least entropy wins, ties go to the first language. The score is the winner's
        share of exp(-10 x nats) over the languages. `und`, 0 and not accepted without letters.
        """
        n, h = self.entropies(text)
        if h is None:
            return "und", 0.0, float("nan"), False
        best = int(h.argmin())
        w = np.exp(-10 * (h - h[best]))
        lang = self.langs[best]
        return lang, float(1 / w.sum()), float(h[best]), self.fits(text, lang, n, float(h[best]))


def _counts(order: int):
    def count(batches):
        seen: dict[str, Counter] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                c = codes(text)
                if not c.any():
                    continue
                c = np.r_[np.zeros(order, dtype=np.uint32), c[1:] if c[0] == 0 else c][1:]
                s = np.where(c == 0, 32, c).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                seen.setdefault(lang, Counter()).update(s[i : i + order] for i in range(len(s) - order + 1))
            if sum(map(len, seen.values())) > 500_000:
                yield from _rows(seen)
                seen = {}
        yield from _rows(seen)

    return count


def _rows(seen):
    for lang, c in seen.items():
        yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})


def calibration(model: Model, pdf: pd.DataFrame) -> pd.DataFrame:
    """(lang, length, own, rest) of pdf(text, lang)'s beginnings of each of LENGTHS, for Model.calibrate.

    A text shorter than a length by less than half counts there as a whole.
    """
    out = []
    for text, lang in zip(pdf["text"], pdf["lang"]):
        if lang not in model.langs:
            continue
        text, j = unmarked(text), model.langs.index(lang)
        size, nats = model.pieces(text, LENGTHS[-1])
        n = int(size.sum())
        if not n or nats.sum(axis=0).argmin() != j:  # labels may be wrong
            continue
        for length in LENGTHS:
            if 2 * n <= length:
                break
            x = nats if length == LENGTHS[-1] else model.pieces(text, length)[1]
            others = np.delete(x, j, axis=1)
            m = min(n, length)
            out.append((lang, length, x.min(axis=1).sum() / m, others.min(axis=1).sum() / m if others.shape[1] else math.nan))
    return pd.DataFrame(out, columns=["lang", "length", "own", "rest"])


def statistics(counts: DataFrame, order: int) -> DataFrame:
    """counts(lang, gram, n) of n-grams of the highest order -> (k, lang, gram, n, total) of all orders, as a written table.

    Each different n-gram is one left neighbour of its last k - 1 characters; `total` sums its
    context's n. All in Spark: what goes to the driver is chosen from these, not counted there.
    """
    out, level, tables = None, materialize(counts.select("lang", "gram", "n"), "ngrams"), []
    for k in range(order, 0, -1):
        context = F.substring("gram", 1, k - 1)
        totals = level.groupBy("lang", context.alias("c")).agg(F.sum("n").alias("total"))
        rows = level.withColumn("c", context).join(totals, ["lang", "c"]).select(F.lit(k).alias("k"), "lang", "gram", "n", "total")
        out = rows if out is None else out.union(rows)
        tables.append(level)
        if k > 1:
            level = materialize(level.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    out = materialize(out, "statistics")
    discard(*tables)
    return out


def fit(counts: DataFrame, order: int = ORDER, max_ngrams: int = MAX_NGRAMS) -> Model:
    """A model of counts(lang, gram, n): discounts and totals of all counts, then at most max_ngrams a length.

    Where a length has more, its languages get even shares of the bound (what one leaves goes to
    the others), and a language over its share leaves out its n-grams of the least counts.
    Single characters all stay.
    """
    rows = statistics(counts, order)
    kinds = pd.DataFrame([tuple(r) for r in rows.groupBy("k", "lang", "n").agg(F.count("*").alias("m")).collect()], columns=["k", "lang", "n", "m"])
    discounts, least = {}, []
    for k, of_length in kinds.groupby("k"):
        sizes = of_length.groupby("lang")["m"].sum().sort_values(kind="stable")
        left, langs = max_ngrams, len(sizes)
        for lang, size in sizes.items():
            mine = of_length[of_length["lang"] == lang].sort_values("n", ascending=False)
            seen = mine.set_index("n")["m"]
            ones, twos = int(seen.get(1, 0)), int(seen.get(2, 0))
            discounts[int(k), lang] = ones / (ones + 2 * twos) if ones and twos else 0.5
            bound = size if k == 1 else max(1, left // langs)
            fits = mine["n"][mine["m"].cumsum() <= bound]
            least.append((int(k), lang, int(fits.min()) if len(fits) else int(mine["n"].max()) + 1))
            left, langs = left - min(size, bound), langs - 1
    langs, levels = sorted(kinds["lang"].unique()), {}
    for k in range(1, order + 1) if langs else ():
        mine = [(lang, langs.index(lang), n) for j, lang, n in least if j == k]
        chosen = F.broadcast(counts.sparkSession.createDataFrame(mine, "lang string, place int, least long"))
        found = rows.where(F.col("k") == k).join(chosen, "lang").where("n >= least").select("gram", "place", "n", "total").toArrow()
        grams = np.frombuffer("".join(found["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, k)
        levels[k] = (np.where(grams == 32, 0, grams).astype(np.uint32), found["place"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64), found["total"].to_numpy().astype(np.float64))
    discard(rows)
    return Model(levels, langs, discounts, order)


def learn(docs: DataFrame, per_lang: int = DOCS_A_LANGUAGE, order: int = ORDER, max_ngrams: int = MAX_NGRAMS, miss: float = 0.001) -> Model:
    """A model from docs(doc_id, text, lang): rows with null text or lang teach nothing.

    Of each language about per_lang documents are used, drawn by a hash of doc_id: three quarters give the counts, a quarter calibrates the rejection, for each
    length of text from both sides: texts of the language, and texts of each other one with that left
    out (Model.calibrate). Empty texts and an empty table give a model that knows no language.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({}, [], {}, order)
    rates = spark.createDataFrame([(k, per_lang / v) for k, v in sizes.items()], "lang string, rate double")
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    part = docs.withColumn("u", u).join(F.broadcast(rates), "lang").where("u < rate").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0)
    counts = part.where("not held or rate > 20").select("text", "lang").mapInPandas(lean(_counts(order)), "lang string, gram string, n long")
    model = fit(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), order, max_ngrams)
    sent = spark.sparkContext.broadcast(model)

    def score(batches):
        for pdf in batches:
            yield calibration(sent.value, pdf)

    known = part.where("held").select("text", "lang").mapInPandas(lean(score), "lang string, length int, own double, rest double").toPandas()
    model.calibrate(known, miss)
    release()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score, entropy, accepted) of every row, whole texts.

    Null texts and texts without letters: und, 0, null, false. Only the text is an input.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            rows = [sent.value.predict(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "entropy", "accepted"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select("doc_id", "text").mapInPandas(lean(run), "doc_id long, lang_pred string, score double, entropy double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text the model accepts."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([sent.value.predict(t)[3] for t in texts], type=pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
