"""The queries that apply the operators to the whole test tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm import (
    alignment,
    bpe,
    embeddings,
    hard_negatives,
    licences,
    line_dedup,
    packing,
    quality,
    quality_gam,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from returnlens.llm.shared import ship_package
from returnlens.session import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed."""
    ship_package(spark, ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), threshold=None)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.classified(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_matches(table(spark, sf_dir, "documents"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), bits=3, words=3)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.read_archive(spark, folder).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def op8_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "clean_text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id")
    labelled = vectors.withColumn("label", hard_negatives.shifted_label(F.col("label"), key))
    return hard_negatives.hard_negatives(labelled, key % 100 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_path, piece_path = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment_counts(table(spark, sf_dir, "documents"), byte_path, piece_path)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gam.graded(docs, model).select(
        "doc_id", quality_gam.held_out("doc_id").alias("held_out"), "score", "predicted"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_licence_scan,
        op4_simhash_groups,
        op5_best_fit_packing,
        op6_token_counts,
        op7_warc_archive,
        op8_embedding_groups,
        op9_bpe_round_trip,
        op10_quality_rules,
        op11_hard_negatives,
        op12_token_alignment,
        op13_quality_classifier,
    )
}
