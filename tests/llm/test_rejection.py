"""Rejection against languages that the model never learned."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import langid

#: Enough texts of each language, where sf0.01 has under 100 of one.
DOCS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.parametrize("left_out", ["en", "de"])
def test_left_out_language(spark, left_out):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang").where("lang is not null")
    model = langid.learn(docs.where(F.col("lang") != left_out))
    some = docs.where("doc_id % 10 = 0")
    got = langid.predict(some, model).join(some, "doc_id").groupBy("lang").agg(F.avg(F.col("accepted").cast("double")).alias("share"))
    share = {r["lang"]: r["share"] for r in got.collect()}
    assert share.pop(left_out) < 0.15 and min(share.values()) > 0.98


def test_second_look(spark):
    """Keys in a short text, and passages of two learned languages in one, do not reject it."""
    import numpy as np
    import pandas as pd

    a, b = "the cat sat on the mat and the rat ate the hat ", "das ist ein haus und der hund geht in den wald "
    rows = pd.concat(langid._counts(3)([pd.DataFrame({"text": [a * 20, b * 20], "lang": ["en", "de"]})]))
    model = langid.fit(spark.createDataFrame(rows), order=3)
    model.limit = {x: np.full(len(langid.LENGTHS), 1.2) for x in model.langs}
    assert model.predict(a)[3] and model.predict(a * 4 + b * 3)[3] and not model.predict("vlkq jwrx ozup mfyb " * 3)[3]
    assert model.predict("the cat sat on the mat b64b244acde2e3b0aa8f")[3] and not model.predict("cat b64b244acde2e3b0aa8fcc01ebaba3addaf")[3]
