"""The queries opN_<name> over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lines, packing, pages, quality, resampling, secrets, sharding, simhash, spelling, toxicity, vectorlinks
from .check_sql import LINKS, RESAMPLING, SPELLING
from .common import table


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeats(docs)


TOKENIZER = "word_bpe_49k.json"


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorlinks.vector_links(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_components, op2_histogram_shards, op3_quality_boosting, op4_toxicity_kernel, op5_permutation_neighbours, op6_page_differencing,
    op7_decontamination, op8_line_chunks, op9_packed_sequences, op10_secret_forest, op11_spelling_variants, op12_importance_resampling, op13_vector_links,
)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"

CHECKS: dict[str, str] = {
    "op7_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
patterns AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS p
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
    FROM docs, (SELECT DISTINCT n FROM patterns) AS lengths, unnest(range(1, len(w) - n + 2)) AS u(i)
),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN patterns USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(pos) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_spelling_variants": SPELLING,
    "op12_importance_resampling": RESAMPLING,
    "op13_vector_links": LINKS,
}
