"""Corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm import mixing, packing, quality_rules, secret_scan, shingle_dedup
from stagewise.llm.common import ensure_checkpoint_dir, removed


# Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, an empty table and further columns of any
# name (they pass through the first four); what each case gives is stated at the stage.


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines above their limit in the others.

    Null and empty texts have no words and go; a null source is a host; rows repeated in whole count as one document and all stay or go."""
    return _sized(quality_rules.keep_good(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id (null last), then the smallest row hash.

    Groups are connected by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash.
    Null and empty texts are one group; repeated rows and rows that share an id count one by one."""
    return shingle_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; null texts stay null, and repeated rows each are cleaned."""
    return _sized(secret_scan.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets; documents come in the order of training, repeated ones each with their own share.

    Texts without words take no part; a null source is the last source."""
    return _sized(mixing.blend(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences, each with its sequence's position in training: documents are packed near the place where mixing wrote them.

    Null texts are the end mark alone; rows that share an id are documents of their own. Docs that don't come from files have no order."""
    ordered = mixing.stored_order(docs.select("doc_id", "text"), "position")
    if ordered is None:
        return packing.pack_pieces(packing.pieces(docs))
    return packing.pack_pieces(packing.pieces(ordered, position_col="position"))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scan", secrets), ("mixing", mix), ("packing", pack)]

#: The shingle sets and the packing are beyond SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again. A stage's table is deleted as soon as the next is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
