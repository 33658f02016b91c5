r"""Exact duplicates by an extendible-hash index on shared files.

Texts are compared after all characters of ``[\x20\x09-\x0D]`` are deleted. A 64-bit hash is the key. The directory
starts with one bucket; while a bucket holds more distinct keys than its capacity it is split by one more bit, doubling
the directory where needed. Rows of one key are chained, and within a chain texts are compared byte by byte (grouping by
the text itself, combined before the shuffle, so that a text that fills a third of the table is one row per task). Each
bucket is a key range with one owner task, which writes its entries to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.materialize import fresh_path

SPACE = r"[\x20\x09-\x0D]+"
#: Distinct keys a bucket holds before it is split, and the most bits of the directory (2^bits rows are broadcast).
CAPACITY, MAX_DEPTH = 20_000, 14


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, SPACE, "")
    rows = docs.select("doc_id", F.length(text).cast("bigint").alias("n_points"), norm.alias("norm"))
    rows = rows.withColumn("key", F.xxhash64("norm"))
    return rows.withColumn("slot", F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int"))


def directory(keys_per_slot: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """(slot, bucket, depth) of every slot at full depth; ``keys_per_slot`` counts distinct keys under each.

    Splits overfull buckets until all fit or have the full depth.
    """
    counts = [[keys_per_slot.get(s, 0) for s in range(1 << max_depth)]]
    while len(counts[-1]) > 1:
        below = counts[-1]
        counts.append([below[i] + below[i + 1] for i in range(0, len(below), 2)])
    by_depth = counts[::-1]
    leaves, open_ = [], [(0, 0)]
    while open_:
        depth, prefix = open_.pop()
        if depth < max_depth and by_depth[depth][prefix] > capacity:
            open_ += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        else:
            leaves.append((depth, prefix))
    leaves.sort(key=lambda leaf: leaf[1] << (max_depth - leaf[0]))
    return [
        (slot, bucket, depth)
        for bucket, (depth, prefix) in enumerate(leaves)
        for slot in range(prefix << (max_depth - depth), (prefix + 1) << (max_depth - depth))
    ]


def build_index(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Write the index to ``path`` and return it: bucket, key, text_sha256, keep_id, group_size.

    Of equal texts the row with the most code points stays, then the smallest doc_id; null doc_ids come last.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    counted = keyed.groupBy("slot").agg(F.approx_count_distinct("key").alias("keys")).collect()  # at most 2^MAX_DEPTH rows
    slots = directory({r.slot: r["keys"] for r in counted}, capacity)
    table = F.broadcast(spark.createDataFrame(slots, "slot int, bucket int, depth int").select("slot", "bucket"))
    chains = keyed.groupBy("slot", "key", "norm", "n_points").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    entries = (
        chains.select("slot", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "n_points", "doc_id", "n")
        .groupBy("slot", "key", "text_sha256")
        .agg(best.alias("best"), F.sum("n").alias("group_size"))
        .join(table, "slot")
        .select("bucket", "key", "text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    )
    entries.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key bigint, text_sha256 string, keep_id {key_type}, group_size bigint, bucket int"
    return spark.read.schema(schema).parquet(path)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; other columns are not read. Null and empty texts, and texts of white space only, are
    one group. Rows that repeat doc_id and text are counted one by one, and all of them have kept true if theirs is the
    id that stays; a null doc_id stays only if its whole group has none, and then kept is true. An empty table gives no rows.
    """
    index = build_index(docs, fresh_path(docs.sparkSession, "exact-index"), capacity)
    rows = _keyed(docs).select("doc_id", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    found = rows.join(index.drop("bucket"), ["key", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns."""
    index = build_index(docs, fresh_path(docs.sparkSession, "exact-index"), capacity)
    kept = index.select(F.col("text_sha256").alias("__kept"), F.col("keep_id").alias("__keep"))
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, SPACE, "").cast("binary")
    rows = docs.withColumns({"__sha": F.sha2(norm, 256), "__points": F.length(text)})
    rows = rows.join(kept, (F.col("__sha") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__keep")), "inner")
    # Only a repeated doc_id can still leave two rows of one text.
    once = rows.dropDuplicates(["__sha"]) if _repeats_ids(docs) else rows
    return once.select(*docs.columns)


def _repeats_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id ASC NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM best
"""
