"""From raw documents to packed training sequences: five stages, one operator each.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
every result as Parquet to the shared folder and rereads it as the next one's
documents. All stages but the last return the columns of their input.

1. quality: documents that the co-trained classifier rejects go.
2. near_dedup: of each SimHash group one row stays, the one with the smallest
   doc_id (nulls after all others; of rows that share that doc_id, the one whose
   text hashes lowest). Rows are told apart by a number of their own, so rows of
   one doc_id, or of none, in different groups all stay.
3. decontamination: rows with a benchmark window go, not others of their doc_id.
4. personal_data: spans are replaced by their kind, ``n_chars`` follows the text.
5. packing: pieces with their place in sequences of 4096 tokens.

SQL cannot express the stages; ``tests/llm/test_pipeline.py`` holds them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, packing, pii, quality, simhash
from quarry.llm.common import stage, table

BROADCAST_IDS = 1_000_000  # 8 MB of ids; more are joined by a shuffle


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row, ``__row``, written once so that the numbers hold."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def texts_by_row(rows: DataFrame) -> DataFrame:
    """What the operators take, with the row number in place of ``doc_id``."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, trained on ``labels``, accepts."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    rows = numbered(docs)
    # component_id: the lowest row number of the group
    groups = simhash.near_duplicates(texts_by_row(rows), shingle=4, max_bits=4).select(F.col("doc_id").alias("__row"), "component_id")
    order = rows.select("__row", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("rest"))
    best = groups.join(order, "__row").groupBy("component_id").agg(F.min(F.struct("none", "id", "text", "rest", "__row")).alias("best"))
    return rows.join(best.select("best.__row"), "__row", "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    rows = numbered(docs)
    found = decontam.contamination(texts_by_row(rows), table(spark, sf_dir, "benchmark"), window=10)
    bad = stage(found.where("contaminated").select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return rows.join(bad, F.col("__row") == F.col("__bad"), "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    clean = pii.redact(docs, pii.train_on(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))[1]


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
