"""A corpus pipeline of five stages, each over all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import discard, materialize, pick
from barloom.llm.decontam import decontaminate
from barloom.llm.entries import n_words, sized
from barloom.llm.langid import keep_accepted, learn
from barloom.llm.minhash import grouped, ids_are_keys
from barloom.llm.mixing import by_rank, mix
from barloom.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a language of the corpus; null, empty and letterless texts go.

    Rows are decided one by one by their whole texts, repeated ones alike; without labels nothing is learned,
    and all go. Columns of any name stay as they are.
    """
    return keep_accepted(docs, learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Where doc_id is null or repeated, rows get numbers in their stored order for this stage, and the
    first row of a group stays. Rows without words are groups of their own.
    """
    if ids_are_keys(docs):
        groups = grouped(docs)
        kept = materialize(groups.where("kept").select(F.col("doc_id").alias("id")), "kept")
        return pick(docs, "doc_id", kept)
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = grouped(rows.select(F.col("__row").alias("doc_id"), "text"))
    kept = materialize(groups.where("kept").select(F.col("doc_id").alias("id")), "kept")
    return pick(rows, "__row", kept).drop("__row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without words hold none, repeated rows are decided alike."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: rows of documents that are taken twice appear twice.

    Rows without a source are of a source of their own; texts without words have size 0, and are taken
    where their place in the seeded order fits. Rows travel as one struct, so no column's name clashes.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", n_words().alias("n"), F.array("source").alias("sources"))
    mixed, _ = mix(rows, "sources", F.col("n"), by_rank)
    copies = mixed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return copies.select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their size, shard (0 to 7, sizes near equal) and slot; columns of these names give way.

    Equal texts lie in one shard unless they are over an eighth of its share; null texts have size 1.
    """
    rows = sized(docs.select(F.struct("*").alias("row"), "doc_id", "text")).drop("text")
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("size", "shard", "slot")]
    return shard(rows, "size", "hashed", "doc_id").select(*kept, "size", "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has no language model; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
