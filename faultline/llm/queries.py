"""The operators as queries over whole tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    containment,
    filter_audit,
    linechunks,
    lm_score,
    personal_data,
    pieces,
    probminhash,
    quality,
    quotes,
    recompression,
    secret_scan,
    vector_codes,
    warc,
)
from faultline.sources.scratch import discard, lasting_path, stored

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_table(spark, sf_dir, "conversations"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linechunks.line_dedup(documents, counts=True, passages=True)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = lasting_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), root)
    records = warc.read_archives(spark, root, payloads=False).select(
        F.col("key").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )
    records = stored(records, "records")
    discard(spark, root)
    return records


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = probminhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return classes.select(F.col("_key").alias("doc_id"), F.col("class_key").alias("class_id"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.benchmark_matches(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_spans(_table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.read_pieces(PIECE_MODEL)
    documents = _table(spark, sf_dir, "documents")
    trip = pieces.round_trip_column(F.col("text"), F.col("doc_id"), vocabulary)
    return documents.select("doc_id", trip.alias("_trip")).select(
        "doc_id",
        "_trip.ids",
        F.size("_trip.ids").cast("bigint").alias("n_pieces"),
        "_trip.lossless",
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.removal_counts(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_vectors(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def queries() -> dict[str, Query]:
    return {
        query.__name__: query
        for query in (
            op1_quotes,
            op2_secrets,
            op3_line_dedup,
            op4_warc,
            op5_near_duplicates,
            op6_contamination,
            op7_quality,
            op8_personal_data,
            op9_pieces,
            op10_lm_scores,
            op11_substring_dedup,
            op12_vector_codes,
            op13_filter_audit,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quotes": quotes.ORACLE,
        "op3_line_dedup": linechunks.ORACLE,
        "op4_warc": warc.ORACLE,
        "op6_contamination": containment.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
