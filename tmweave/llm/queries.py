"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, html_extract, jaccard_join, language_id, mixing, personal_data, sentencepiece_wfst, token_counts, token_records, topk, vector_codes, warc
from .common import table


def vocabulary(name: str) -> str:
    """A public vocabulary file: in the folder TOKENIZERS_DIR, or where the package public_tokenizers has it."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_copies(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_exact_topk, op3_language_id, op4_source_mixing, op5_sentencepiece, op6_fingerprints, op7_token_counts, op8_jaccard_join, op9_warc, op10_token_records, op11_vector_codes, op12_alignment, op13_personal_data)
}


def vector_codes_sql() -> str:
    """Vector codes with every distance computed: vectors of equal dimension, a multiple of 16."""
    nearest = "SELECT rid, p, e, dist FROM (SELECT k.rid, k.p, b.e, sum((k.x - b.x) * (k.x - b.x)) AS dist, row_number() OVER (PARTITION BY k.rid, k.p ORDER BY sum((k.x - b.x) * (k.x - b.x)), b.e) AS nth FROM k JOIN {book} b ON b.p = k.p AND b.c = k.c GROUP BY k.rid, k.p, b.e) WHERE nth = 1"
    mean = "SELECT b.p, b.e, b.c, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM {book} b LEFT JOIN (SELECT k.p, a.e, k.c, sum(k.x)::BIGINT AS s, count(*) AS n FROM k JOIN {a} a USING (rid, p) GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.c = b.c"
    steps = [f"a{i} AS MATERIALIZED ({nearest.format(book=f'b{i}')}), b{i + 1} AS MATERIALIZED ({mean.format(book=f'b{i}', a=f'a{i}')})" for i in range(2)]
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        k AS MATERIALIZED (SELECT rid, (i - 1) // (len(v) // 16) AS p, (i - 1) % (len(v) // 16) AS c, v[i] AS x FROM kept, range(1, len(v) + 1) t(i)),
        b0 AS MATERIALIZED (SELECT p, rid AS e, c, x FROM k WHERE rid < 64), {', '.join(steps)},
        last AS MATERIALIZED ({nearest.format(book='b2')}),
        codes AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM last GROUP BY rid),
        rows AS (SELECT kept.vec_id, kept.label, code, error FROM kept JOIN codes USING (rid))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, c)) FROM b2) AS codebooks_sha256 FROM rows"""


ORACLES: dict[str, str] = {"op11_vector_codes": vector_codes_sql()}
