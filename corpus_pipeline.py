"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

Every stage takes what its predecessor kept. All but the last return the columns of documents; where a stage changes a
text, ``n_chars`` follows. Every row is a document of its own, whatever its ``doc_id``: the stages that compare
documents tell rows apart by a number, which they write with their input. Columns they add have names the input lacks.
An empty input gives no rows; NULL texts are empty ones; a text is held as a whole by the task that works on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm import line_dedup, quality, queries, simhash, toxicity
from returnlens.llm.shared import written
from returnlens.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows that travel to Python at once. An executor holds such batches beside its heap, and keeps much of their space.
BATCH_ROWS = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of the training fold, scores below its threshold.

    A row is scored by its text alone: repeated rows and rows without an id stay or go as they would alone.
    """
    _prepare(spark)
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    score = _free("score", docs)
    scored = docs.withColumn(score, model.column("text"))
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep, without their failing lines. Rows are judged one by one; repeated ones alike."""
    judged = quality.quality(docs.select(F.struct(*docs.columns).alias("row"), "text")).filter("kept")
    text = F.col("clean_text")
    return _with_text(judged, docs.columns, text, text.eqNullSafe(F.col("row.text")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat an earlier one; those that lose all their words go."""
    _prepare(spark)
    numbered, row = _numbered(docs)
    # The text is shuffled once: of the old one only its length and whether it has words go along.
    others = [c for c in docs.columns if c.lower() != "text"]
    rows = numbered.select(
        F.struct(*others).alias("row"), F.struct("doc_id", row).alias("place"), "text", F.length("text").alias("chars"),
        (F.length(quality.bare(F.col("text"))) > 0).alias("worded"),
    )
    classes = line_dedup.line_classes(rows, threshold=None, key="place")
    cleaned = line_dedup.without_repeated_lines(rows, classes, key="place")
    emptied = F.col("worded") & (F.length(quality.bare(F.col("text"))) == 0)
    # A line that goes has a word, so a text that loses one is shorter.
    same = F.length("text").eqNullSafe(F.col("chars"))
    return _with_text(cleaned.filter(~F.coalesce(emptied, F.lit(False))), docs.columns, F.col("text"), same)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints, one row: the first of the smallest id."""
    _prepare(spark)
    numbered, row = _numbered(docs)
    # A NULL id comes last.
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col(row).alias("number"))
    groups = simhash.simhash_groups(numbered.select(place.alias("place"), "text"), bits=3, words=3, key="place")
    kept = groups.filter(F.col("place").eqNullSafe(F.col("component_id"))).select(F.col("place.number").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences. Every row has pieces of its own, a NULL text the end id alone."""
    _prepare(spark)
    return queries.packed_documents(docs)


def _prepare(spark: SparkSession) -> None:
    """Settings of the session that stages with Python work rely on; fewer rows at once stay as they are."""
    queries.prepare(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _free(name: str, docs: DataFrame) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written so that every read sees the same, and the number's column."""
    row = _free("row_number", docs)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _with_text(rows: DataFrame, columns: list[str], text: Column, same: Column) -> DataFrame:
    """The columns of ``row`` with another text, and its length where it is not the same."""
    values = {"text": text, "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length(text))}
    return rows.select(*(values.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_documents),
]

# A trained classifier, edit distances, fingerprints and tokenizers are beyond SQL; the tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage reads what its predecessor wrote in the shared folder."""
    docs = queries.table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
