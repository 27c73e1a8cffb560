"""The registered query of each corpus operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, collocations, decontaminate, html_text, language_id, minhash_dedup, quality, secrets, substring_dedup, suffix_family, url_filter, vector_codes, warc
from quern.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to compressed archives and read back by byte ranges."""
    files = warc.archive(spark, _read(spark, sf_dir, "pages"), least=0)
    back = warc.read(files)
    page, refers = F.col("page_id").cast("long"), F.col("refers_to").cast("long")
    return back.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, links at 80 of 100."""
    return minhash_dedup.components(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are removed."""
    out = substring_dedup.dedup(_read(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(_read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(_read(spark, sf_dir, "documents")).drop("rejected_by")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice are removed; texts come in three batches."""
    out = suffix_family.dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_minhash_dedup,
        op3_decontaminate,
        op4_bpe,
        op5_substring_dedup,
        op6_url_filter,
        op7_language_id,
        op8_html_text,
        op9_secrets,
        op10_quality,
        op11_vector_codes,
        op12_collocations,
        op13_suffix_dedup,
    )
}
