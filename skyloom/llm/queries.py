"""The registered queries of the text operators, one opN_<name> each, and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bpe, cotrain, exact_dedup, hmm_lm, html_extract, license_scan, packing, quality_rules, simhash_dedup, token_counts
from skyloom.llm.common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    # the sums read the histogram more than once; the corpus is encoded once
    return token_counts.suffix_sums(Scratch(spark, "lengths").write(token_counts.histogram(lengths), "histogram"))


def op5_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_read(spark, sf_dir, "documents"), words=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(encoder: bpe.PrefixEncoder, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(encoder.names.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    return bpe.encode_map(
        _read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        digests,
        ("n_tokens", "ids_sha256", "decoded_sha256"),
        ("long", "string", "string"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_exact_dedup,
        op3_quality_classifier,
        op4_token_counts,
        op5_hmm_scoring,
        op6_html_extraction,
        op7_packing,
        op8_license_scan,
        op9_simhash,
        op10_bpe,
    )
}

ORACLE = {
    "op8_license_scan": license_scan.scan_sql(),
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), g AS (
            SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id
            FROM t GROUP BY norm
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm
    """,
}
