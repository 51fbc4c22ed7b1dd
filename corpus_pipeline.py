"""From raw documents to packed training sequences.

language_id       documents without a letter go; `lang` becomes the predicted language (ambiguous ones keep theirs)
exact_dedup       of equal texts (A-Z lower-cased) the one with the largest doc_id stays
simhash_near_dedup  of each group of near copies (five-word shingles, similarity 0.8 and more) one stays
secret_scan       secrets are replaced by [SECRET]; every document stays
best_fit_packing  documents are packed into sequences; one row per piece
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from parley.llm.common import documents, fresh, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too) go; equal and repeated rows fare alike."""
    names = tuple(fresh(docs, x) for x in ("lang_pred", "score", "ambiguous"))
    named = language_id.identify(docs, language_id.train(docs), names=names)
    sure = named.where(F.col(names[0]) != language_id.UNKNOWN)
    return sure.withColumn("lang", F.when(F.col(names[2]) & F.col("lang").isNotNull(), F.col("lang")).otherwise(F.col(names[0]))).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, of null and empty texts together one; of repeated rows one."""
    return exact_dedup.keep_first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one of the smallest doc_id; empty texts are one group; repeated rows count as one."""
    return near_dedup.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null texts stay null (n_chars too) and empty ones empty."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is packed, repeated ones each on its own; null and empty texts have one token, very long ones are cut."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Neither the classifier nor the packing can be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each one's rows written before the next reads them; an empty table gives no rows.

    Further columns of documents, whatever their names, pass all stages but the last as they are.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
