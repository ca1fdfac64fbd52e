"""The language models against a plain-Python interpolated Kneser-Ney."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import langid

TEXTS = {
    "en": "the cat sat on the mat and the rat ate the hat that sat there",
    "de": "der hund und die katze sind im haus und der mann ist da",
    "xx": "zzz qq zz qqq zq",
}


def coded(text):
    return [0 if x == 0 else int(x) for x in langid.codes(text)]


def grams(text, order):
    c = [0] * (order - 1) + coded(text)
    return [tuple(c[i : i + order]) for i in range(len(c) - order + 1)]


class Brute:
    """p(w | c) = max(0, n(cw) - d) / n(c) + d * kinds(c) / n(c) * p(w | c without its first character)."""

    def __init__(self, text, order, alphabet):
        self.alphabet, self.levels = alphabet, {}
        counts = Counter(grams(text, order))
        for k in range(order, 0, -1):
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in counts.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
            self.levels[k] = (counts, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5)
            counts = Counter(g[1:] for g in counts)

    def p(self, g):
        if not g:
            return 1 / self.alphabet
        counts, total, kinds, d = self.levels[len(g)]
        c = g[:-1]
        if not total.get(c):
            return self.p(g[1:])
        return max(0, counts.get(g, 0) - d) / total[c] + d * kinds[c] / total[c] * self.p(g[1:]) if g in counts else d * kinds[c] / total[c] * self.p(g[1:])


def table(spark, order, texts=TEXTS):
    show = lambda g: "".join(" " if x == 0 else chr(x) for x in g)
    rows = [(lang, show(g), n) for lang, t in texts.items() for g, n in Counter(grams(t, order)).items()]
    return spark.createDataFrame(rows, "lang string, gram string, n long")


@pytest.mark.parametrize("order", [2, 3, 5])
def test_against_brute_force(spark, order):
    model = langid.fit(table(spark, order), order)
    alphabet = len({x for t in TEXTS.values() for x in coded(t)}) + 1
    assert model.alphabet == alphabet and model.langs == sorted(TEXTS)
    brute = {lang: Brute(t, order, alphabet) for lang, t in TEXTS.items()}
    r = random.Random(order)
    for text in [*TEXTS.values(), "that hund ist zq über alles", *["".join(r.choice("abcdehinstz qü") for _ in range(40)) + "a" for _ in range(20)]]:
        n, h = model.entropies(text)
        c = coded(text)
        c = [0] * order + (c[1:] if c[0] == 0 else c)
        for i, lang in enumerate(model.langs):
            want = -sum(math.log(brute[lang].p(tuple(c[j - order + 1 : j + 1]))) for j in range(order, len(c)))
            assert n == len(c) - order and h[i] * n == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("bound", [10**6, 60, 12, 1])
def test_sums_to_one_however_many_are_left_out(spark, bound):
    order = 3
    model = langid.fit(table(spark, order), order, max_ngrams=bound)
    alphabet = sorted({x for t in TEXTS.values() for x in coded(t)})
    assert all(len(model.prob[k].key) <= max(bound, len(TEXTS)) for k in range(2, order + 1)) and len(model.prob[1].key) == len(alphabet)
    for context in ([0, ord("t")], [ord("t"), ord("h")], [ord("q"), 0], [ord("ü"), ord("ö")]):
        rows = np.array([[*context, x] for x in [*alphabet, 0x10FFFF]], dtype=np.uint32)  # the last stands for all unknown ones
        assert np.exp(model._log(rows)).sum(axis=0) == pytest.approx(np.ones(len(TEXTS)), abs=1e-5)


def test_a_small_language_keeps_its_ngrams(spark):
    """The bound is shared by language: the large ones leave out theirs first, and discounts are of all counts."""
    counts = table(spark, 3)
    full, part = langid.fit(counts, 3), langid.fit(counts, 3, max_ngrams=40)
    for g in set(grams(TEXTS["xx"], 3)):
        key = langid.gram_keys(np.array([g], dtype=np.uint32))
        assert part.prob[3].find(key)[0] >= 0
    r = random.Random(1)
    texts = ["".join(r.choice("zq ") for _ in range(9)) + "z" for _ in range(9)]
    i = full.langs.index("xx")
    assert [part.entropies(t)[1][i] for t in texts] == pytest.approx([full.entropies(t)[1][i] for t in texts], rel=1e-5)
