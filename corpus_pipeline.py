"""From raw documents to training pieces, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written and
read back as the next one's ``docs``. All but the last return the columns of
``documents``. A stage holds what its operator's docstring says for nulls, empty
texts, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import containment, linechunks, pieces, probminhash, quality
from faultline.llm.queries import PIECE_MODEL
from faultline.sources.scratch import stored

# MCD outliers and keyed merge-dropout have no SQL. Each stage's operator is tested
# on its own in tests/llm, the pipeline for what it keeps and for lossless pieces.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks and passages; ``n_chars`` follows the text."""
    cleaned = linechunks.line_dedup(docs, passages=True)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return containment.decontaminated(docs, benchmark)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids beside what identifies a document, checked to decode losslessly."""
    vocabulary = pieces.read_pieces(PIECE_MODEL)
    trip = pieces.round_trip_column(F.col("text"), F.col("doc_id"), vocabulary)
    encoded = docs.select("doc_id", "lang", "source", trip.alias("_trip"))
    return encoded.select(
        "doc_id", "lang", "source", F.col("_trip.ids").alias("pieces"), "_trip.lossless"
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
