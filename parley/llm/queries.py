"""The registered queries over the corpus operators and their SQL."""

from __future__ import annotations

from .bpe import bpe_report, read_ranks
from .common import LOWER, UPPER, documents
from .exact_dedup import exact_dedup
from .filter_audit import filter_interactions, interactions_sql
from .language_id import language_report
from .license_scan import license_passages
from .order_minhash import order_minhash_report
from .packing import pack_documents
from .ppm import ppm_report
from .secret_scan import secrets_report
from .simhash import near_components
from .source_audit import divergence_sql, source_divergence
from .toxicity import toxicity_report
from .warc import warc_report


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe_report(documents(spark, sf_dir), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op2_order_minhash(spark, sf_dir):
    return order_minhash_report(documents(spark, sf_dir))


def op3_warc_archive(spark, sf_dir):
    return warc_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_simhash_near_dedup(spark, sf_dir):
    return near_components(documents(spark, sf_dir))


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))


def op6_ppm_scoring(spark, sf_dir):
    return ppm_report(documents(spark, sf_dir))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op8_secret_scan(spark, sf_dir):
    return secrets_report(documents(spark, sf_dir))


def op9_license_scan(spark, sf_dir):
    return license_passages(documents(spark, sf_dir))


def op10_language_id(spark, sf_dir):
    return language_report(documents(spark, sf_dir))


def op11_counterfactual_toxicity(spark, sf_dir):
    return toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_filter_interactions(spark, sf_dir):
    return filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence(documents(spark, sf_dir))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {
        "op7_exact_dedup": f"""
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM d""",
        "op12_filter_interactions": interactions_sql(),
        "op13_source_divergence": divergence_sql(),
    }
