"""Order MinHash of texts with fewer k-mers than two a bucket."""

from pyspark.sql import functions as F

from barloom.llm import fingerprint

from .test_edges import words


def test_short_texts_keep_order(spark):
    rows = []
    for n in (20, 40, 80):
        for k in range(40):
            w = words(n, 1000 * n + k).split()
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2]), " ".join(w[: n - 2] + ["zz", "yy"]), words(n, 1000 * n + k + 500)))
    t = spark.createDataFrame(rows, "n int, a string, swapped string, near string, other string").select("n", *[fingerprint.signature(F.col(c)).alias(c) for c in ("a", "swapped", "near", "other")])
    t = t.select("n", *[fingerprint.likeness(F.col("a"), F.col(c)).alias(c) for c in ("swapped", "near", "other")], F.size("a").alias("filled"))
    got = {r["n"]: r for r in t.groupBy("n").agg(*[F.avg(c).alias(c) for c in ("swapped", "near", "other", "filled")]).collect()}
    print(got)
    assert all(r["swapped"] < 0.6 < r["near"] and r["other"] < 0.02 and r["filled"] == 64 for r in got.values())
