"""From raw documents to packed token sequences: five stages, each a written table that the next one reads.

Quality classifier, exact copies, near copies, mixing to target weights, packing. Every stage works on all that the
stage before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import compress_quality, exact_index, mixing, odd_minhash, packing
from plumbline.plans.materialize import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model learns from labelled documents of this input.

    Null and empty texts are scored as the empty text. Without labels of both classes all score alike.
    """
    model = compress_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = compress_quality.score(_columns(docs), model, "__score")
    return scored.where(F.col("__score") >= compress_quality.THRESHOLD).drop("__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, white space aside; null and empty texts are one group."""
    return _columns(exact_index.drop_exact_copies(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8, the smallest doc_id.

    Documents without a doc_id or without words belong to no group and stay.
    """
    groups = odd_minhash.near_groups(docs, size=5)
    # A written table has a size to plan by: texts are not shuffled against ids that fit a broadcast.
    dropped = materialize(groups.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return _columns(docs.join(dropped, "doc_id", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _columns(mixing.emit(mixing.mix(_columns(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with checksums of their ids."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Compression and tokenizers are not in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
