"""A corpus pipeline: quality, near duplicates, decontamination, personal data, encoding.

``STAGES`` are applied in order to the table ``documents``; each stage's result is written as Parquet in the shared
folder and read again as the next one's documents. All stages but the last return the columns of documents.

Stages that remove documents remove rows, not ids: rows get a key in a stored copy first, so rows without an id and rows
that share one are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.llm import decontamination, jaccard, pieces, pii, quality
from gridrisk.llm.common import discard, fresh_name, hinted, label_fold, stored, table

#: The texts after the last stage are sampled, so no SQL gives the rows of run().
ORACLE_SQL = None


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows outside fold 1 of 3 among docs."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    forest = quality.learn_quality(docs, labels, label_fold(F.col("doc_id"), 3) != 1)
    score = fresh_name(docs, "score")
    return quality.score_quality(docs, forest, out=score).where(F.col(score) >= 0.5).drop(score)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """A stored copy of docs with a key for each row, and the key's name."""
    key = fresh_name(docs, "row")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without_rows(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys gone has, and without the key."""
    return docs.join(hinted(gone), key, "left_anti").drop(key)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id, rows without an id coming last, and of equal
    ids any one. Documents without words link with nothing and stay."""
    docs, key = _keyed(docs)
    rank = fresh_name(docs, "rank")
    ranked = docs.withColumn(rank, F.struct(F.isnull("doc_id").alias("absent"), F.col("doc_id").alias("id"), F.col(key).alias("row")))
    found = jaccard.near_duplicates(ranked, rank).where("id <> component_id")
    return _without_rows(docs, key, stored(found.select(F.col("id.row").alias(key)), "gone"))


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs, key = _keyed(docs)
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col=key)
    return _without_rows(docs, key, stored(leaks.select(key).distinct(), "leaks"))


def _private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by marks; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a sampled segmentation of their texts and a check of what it decodes to."""
    return pieces.sample_pieces(docs)


STAGES = [
    ("quality classifier", _quality),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontaminated),
    ("PII", _private),
    ("SentencePiece encoding and decoding", _encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            discard(before)
    return docs
