"""Repeated passages against brute force, on texts whose copies are cut at every place."""

import random

import pytest

from barloom.llm.suffix_dedup import repeated_passages


def cut_copies(seed: int, docs: int, bases: int = 2) -> list[tuple[int, str]]:
    """Texts of pieces of a few base texts, so one minimiser meets many different contexts."""
    r = random.Random(seed)
    base = [[f"b{i}w{r.randrange(10_000)}" for _ in range(110)] for i in range(bases)]
    out = []
    for d in range(docs):
        text = []
        for _ in range(r.randrange(1, 5)):
            b, at = r.choice(base), r.randrange(80)
            text += b[at : at + r.randrange(15, 70)] + [f"f{r.randrange(6)}" for _ in range(r.randrange(1, 3))]
        out.append((d, " ".join(text)))
    return out


def brute_force(rows, least: int, within: bool) -> list[tuple]:
    where: dict[tuple, set] = {}
    split = {d: t.split() for d, t in rows}
    for d, w in split.items():
        for s in range(len(w) - least + 1):
            where.setdefault(tuple(w[s : s + least]), set()).add((d, s))
    out = []
    for d, w in split.items():
        spans: list[list[int]] = []
        for s in range(len(w) - least + 1):
            places = where[tuple(w[s : s + least])]
            if len(places) > 1 if within else len({x for x, _ in places}) > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least])
        out += [(d, a, b, b - a) for a, b in spans]
    return sorted(out)


@pytest.mark.parametrize(("seed", "docs", "within", "parts"), [(1, 60, False, 4), (2, 12, False, 1), (3, 60, True, 4), (4, 150, False, 16), (5, 8, False, 1)])
def test_cut_copies(spark, seed, docs, within, parts):
    rows = cut_copies(seed, docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), within=within)
        assert sorted(tuple(r) for r in got.collect()) == brute_force(rows, 50, within)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_passage_twice_in_one_document(spark):
    """Both places count, though one document's two suffixes are neighbours."""
    r = random.Random(9)
    new = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    for seed in range(3):
        p = " ".join(f"p{seed}{i}" for i in range(60))
        rows = [(1, f"{new(70)} {p} {new(70)} {p} {new(70)} {p} {new(9)}"), (2, f"{new(5)} {p} {new(60)}"), (3, f"{new(90)}")]
        got = sorted(tuple(x) for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute_force(rows, 50, False)


def by_text(rows, least: int) -> list[tuple]:
    """As brute_force, for rows of which several may have one doc_id and different texts."""
    where: dict[tuple, set] = {}
    for d, t in rows:
        w = t.split()
        for s in range(len(w) - least + 1):
            where.setdefault(tuple(w[s : s + least]), set()).add(d)
    out = set()
    for d, t in rows:
        spans: list[list[int]] = []
        w = t.split()
        for s in range(len(w) - least + 1):
            if len(where[tuple(w[s : s + least])]) > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least])
        out |= {(d, a, b, b - a) for a, b in spans}
    return sorted(out)


@pytest.mark.parametrize("seed", [11, 12])
def test_one_id_of_many_texts(spark, seed):
    """Long and short texts under one doc_id, in any order, with repeated rows."""
    r = random.Random(seed)
    rows = [(d % 9, t) for d, t in cut_copies(seed, 40)] + [(0, "w"), (3, ""), (4, " ".join(f"q{i}" for i in range(900)))]
    rows += rows[:5]
    r.shuffle(rows)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(x) for x in got.collect()) == by_text(rows, 50)


@pytest.mark.parametrize("parts", [1, 24])
def test_long_runs_cross_tasks(spark, parts):
    """One document holds a k-mer in hundreds of contexts, more than a batch and a task hold; others share some."""
    r = random.Random(parts)
    line = [f"l{i}" for i in range(45)]
    text = []
    for i in range(400):
        text += [f"x{r.randrange(4)}", *line, f"y{r.randrange(4)}"]
    rows = [(1, " ".join(text)), (2, " ".join(text[940:1100])), (3, " ".join(["z", *text[47:130]])), (4, " ".join(line + ["y0", "x1"] + line))]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(tuple(x) for x in got.collect()) == brute_force(rows, 50, False)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
