"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import collapse
from .common import WORD
from .decontam import contaminated
from .fingerprint import fingerprints
from .langid import learn, predict
from .minhash import near_duplicates
from .mixing import by_rank, mix
from .sharding import shard
from .suffix_dedup import repeated_passages
from .tokens import encode_documents
from .warc import read_archives, write_archives

VOCABULARY, END_ID = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur in two documents or more."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = learn(docs.where(~held))
    out = predict(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", "accepted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size (bytes of the text plus 1) and hashed (of the text), the shards' keys."""
    return docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "hashed": F.xxhash64("text")})


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(_table(spark, sf_dir, "documents"))
    docs = docs.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "hashed")
    return shard(docs, "size", "hashed", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(_table(spark, sf_dir, "conversations"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), VOCABULARY, END_ID)


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("n"), F.array("source").alias("sources"))
    mixed, targets = mix(docs, "sources", F.col("n"), by_rank)
    targets = F.broadcast(targets.withColumnRenamed("source", "s")) if targets.count() <= 100_000 else targets.withColumnRenamed("source", "s")
    out = mixed.join(targets, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_suffix_array_dedup, op2_language_id, op3_warc, op4_order_minhash, op5_decontamination,
            op6_sharding, op7_chat_collapse, op8_minhash_near_dedup, op9_token_files, op10_mixing,
        )
    }


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_SHINGLES = """
{0}_words AS (SELECT {1} AS id, {2} AS w FROM {3} WHERE text IS NOT NULL),
{0}_places AS (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM {0}_words WHERE len(w) > 0),
{0} AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], chr(31)) AS g FROM {0}_places),
{0}_sizes AS (SELECT id, count(*) AS n FROM {0} GROUP BY id)"""


def oracle_sql() -> dict[str, str]:
    docs = _SHINGLES.format("d", "doc_id", _WORDS, "documents")
    items = _SHINGLES.format("b", "item_id", _WORDS, "benchmark")
    return {
        "op1_suffix_array_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 50)) AS s FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 50], chr(31))) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
f AS (SELECT DISTINCT doc_id, s FROM h WHERE h IN (SELECT h FROM r)),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM f),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word, CAST(max(s) + 50 - min(s) AS BIGINT) AS n_words
FROM i GROUP BY doc_id, island""",
        "op3_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
        "op5_decontamination": f"""
WITH {docs}, {items},
s AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment
FROM s JOIN b_sizes ON item_id = id WHERE 100 * n_shared >= 75 * n""",
        "op7_chat_collapse": """
WITH t AS (SELECT conv_id, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS said,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations),
p AS (SELECT conv_id, i, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY i) AS chat, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT chat, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE i = n GROUP BY chat, n)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, copies, chat || '<|end|>' AS chat FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = w.n AND p.chat = w.chat)""",
        "op8_minhash_near_dedup": f"""
WITH RECURSIVE {docs},
common AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM d x JOIN d y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN d_sizes p ON p.id = a JOIN d_sizes q ON q.id = b WHERE 100 * m >= 75 * (p.n + q.n - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = id WHERE root < b),
least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN d_sizes ON d_sizes.id = doc_id LEFT JOIN least ON least.id = doc_id""",
        "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM s),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM o),
v AS (SELECT *, w * (total - caps) / (ws - cw) > 2 * source_size AS capped FROM c),
l AS (SELECT coalesce(sum(2 * source_size) FILTER (capped), 0) AS caps, coalesce(sum(w) FILTER (capped), 0) AS cw FROM v),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE (total - l.caps) * w / (ws - l.cw) END AS target FROM v, l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(1, source_size) AS base, CAST(floor(target + 0.5) AS BIGINT) % greatest(1, source_size) AS rest FROM t),
e AS (SELECT d.*, q.source_size, q.target, q.base, q.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) <= q.rest AS fits
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (SELECT *, rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM e),
n AS (SELECT *, NOT fits AND size > 0 AND abs(size - gap) < gap AS near FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source, near ORDER BY abs(size - gap), h, size) AS place FROM n)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (base + CASE WHEN fits OR (near AND place = 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    }
