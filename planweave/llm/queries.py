"""Registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.byte_bpe import decode_ids, encode_texts
from planweave.llm.common import documents
from planweave.llm.divergence import duckdb_sql as divergence_sql
from planweave.llm.divergence import source_divergence
from planweave.llm.exact_dedup import exact_dedup
from planweave.llm.licenses import duckdb_sql as license_sql
from planweave.llm.licenses import scan_licenses
from planweave.llm.line_dedup import dedup_lines
from planweave.llm.line_dedup import duckdb_sql as line_dedup_sql
from planweave.llm.mixing import mix_sources
from planweave.llm.packing import best_fit_packing
from planweave.llm.simhash import simhash_groups
from planweave.llm.spelling import duckdb_sql as spelling_sql
from planweave.llm.spelling import spelling_variants
from planweave.llm.suffix_dedup import dedup_strings
from planweave.llm.topk import top_k_inner
from planweave.llm.toxicity import score_toxicity
from planweave.llm.warc import warc_round_trip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(documents(spark, sf_dir))


def tokenizer_file() -> str:
    """The public tokenizer that packing counts with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), tokenizer_file())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode_ids(encode_texts(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mix_sources": op4_mix_sources,
    "op5_topk": op5_topk,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_suffix_dedup": """
        WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
        w AS (SELECT doc_id, p, b[p:p + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM t WHERE n >= 100)),
        r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
        i AS (SELECT doc_id, p, sum(jump) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, (p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100)::INT AS jump FROM r)),
        g AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS e FROM i GROUP BY doc_id, run),
        k AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g),
        c AS (SELECT doc_id, sum(e - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last_end FROM g GROUP BY doc_id),
        h AS (SELECT k.doc_id, string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS kept FROM k JOIN t ON k.doc_id = t.doc_id GROUP BY k.doc_id)
        SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
          CASE WHEN h.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[last_end + 1:n]))) END AS kept_sha256
        FROM t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN h ON t.doc_id = h.doc_id""",
    "op5_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INT AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op1_license_scan": license_sql(),
    "op7_line_dedup": line_dedup_sql(),
    "op11_source_divergence": divergence_sql(),
    "op13_spelling_variants": spelling_sql(),
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        b AS (SELECT html, max(page_id) AS best FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
          CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN best <> page_id THEN best END AS refers_to
        FROM p LEFT JOIN b ON p.html = b.html""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
}
