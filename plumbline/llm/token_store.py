"""Token ids in Parquet files that can be read in part.

Documents are ordered by doc_id over range partitions, encoded once, and written as one row each: ids as a list column
with dictionary encoding, keys and positions as delta-encoded columns. Row groups and pages have set sizes and the
files carry page indexes, so a reader can take a few columns, a range of doc_ids, or only lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tokens import crc32, encoder
from plumbline.plans.materialize import fresh_path

VOCABULARY, END_ID = "word_bpe_49k.json", 2
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
#: More parts than this are joined to their offsets without a broadcast.
BROADCAST_PARTS = 100_000


def _writer(vocabulary: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, position = encoder(vocabulary).encode_all, 0
        for batch in batches:
            for first, ends, ids in encode_all(batch.column(1), end_id):
                offsets = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                keys = batch.column(0).slice(first, len(ends))
                columns = [keys, pa.array(position + offsets[:-1]), pa.array(np.diff(offsets)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file_start", "n_tokens", "ids"])
                position += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write one row per document to ``path``, files and rows in ascending doc_id order.

    ``docs`` needs doc_id and text. Null doc_ids come first. A null or empty text is its end id alone. Rows of one
    doc_id are ordered by a hash of their text, so reruns agree. ``file_start`` counts the ids before a row in its part, which is
    one file or, where files are limited in rows, several. An empty table gives no rows.
    """
    source = docs.select("doc_id", "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    key = source.schema["doc_id"].dataType.simpleString()
    rows = source.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = rows.mapInArrow(_writer(vocabulary, end_id), f"doc_id {key}, file_start bigint, n_tokens bigint, ids array<int>")
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .parquet(path)
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ids = lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        sums = [crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "part", "file_start")]
        columns = [*kept, pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "file_start", "n_tokens", "ids_crc32"])


def _part() -> Column:
    """Number of a row's part: parts are in the order of their numbers, not of their names."""
    return F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and the number of its part, which orders the parts, of every document; the ids are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens", _part().alias("part"))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    parts = read_lengths(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total")).collect()  # one row a part
    before, offsets = 0, []
    for part, total in sorted((r.part, r.total) for r in parts):
        offsets.append((part, before))
        before += total
    starts = spark.createDataFrame(offsets, "part int, before bigint")
    if len(offsets) <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    stored = spark.read.parquet(path)
    rows = stored.select("doc_id", "file_start", "ids", _part().alias("part"))
    key = stored.schema["doc_id"].dataType.simpleString()
    sums = rows.mapInArrow(_checksums, f"doc_id {key}, part int, file_start bigint, n_tokens bigint, ids_crc32 bigint")
    return sums.join(starts, "part").select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files in the shared folder and read them back."""
    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digest(spark, path)
