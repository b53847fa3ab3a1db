"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.decontam import repeats

    return repeats(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings", spread=True))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages", spread=True))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.token_counts import prefix_counts

    counts = prefix_counts(table(spark, sf_dir, "documents", spread=True), budget=4096, keep_table=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "n_chars_in_budget")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.substring import digests

    return digests(table(spark, sf_dir, "documents", spread=True))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"), shards=8)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.licenses import recognised

    return recognised(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents", spread=True))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents", spread=True))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "pipeline": pipeline,
}

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
u AS (SELECT DISTINCT doc_id, ws FROM d),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM u),
ranked AS (SELECT doc_id, p, rank() OVER (PARTITION BY array_to_string(ws[p:p + 19], ' ') ORDER BY doc_id, p) AS rn FROM places),
steps AS (SELECT doc_id, i, sum(s) AS s FROM (SELECT doc_id, p AS i, 1 AS s FROM ranked WHERE rn > 1 UNION ALL SELECT doc_id, p + 20, -1 FROM ranked WHERE rn > 1) GROUP BY 1, 2),
words AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM u)),
covered AS (SELECT w.doc_id, w.i, w.w, sum(coalesce(s.s, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS c FROM words w LEFT JOIN steps s ON s.doc_id = w.doc_id AND s.i = w.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE c > 0) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE c = 0) AS t FROM covered GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

SHARD_SQL = """
WITH one AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(pairs, lambda p: CAST('0x' || p AS BIGINT))), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM h, one),
sums AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) AS upto, sum(size) OVER () AS total FROM crc),
placed AS (SELECT *, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM sums)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least_ AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least_
"""


def _oracles() -> dict[str, str]:
    from strandloom.llm import licenses

    return {"op3_embedding_near_dedup": EMBEDDING_SQL, "op6_substring_dedup": SUBSTRING_SQL, "op7_sharding": SHARD_SQL, "op8_license_scan": licenses.duckdb_sql()}


ORACLE_SQL: dict[str, str] = _oracles()
