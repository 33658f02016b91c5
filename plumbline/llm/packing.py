"""Packing by powers of two: no padding, and no sequence holds two documents.

Each document's ids are cut into pieces whose lengths are the binary digits of its length, whole ``limit`` pieces
first. Pieces of equal length form a bucket, and each piece is one sequence of its bucket, so a trainer batches by
bucket. Encoding and cutting happen in the scan: no shuffle, no state, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tokens import encoder

VOCABULARY, END_ID, LIMIT = "byte_bpe_50k.json", 1, 2048

_PIECES = "doc_id {key}, start bigint, length int, ids binary, doc_tokens bigint, bucket int"


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order: whole limits, then the binary digits of the rest from the top."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << bit for bit in reversed(range(limit.bit_length())) if rest >> bit & 1]


def _cutter(vocabulary: str, end_id: int, limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(vocabulary).encode_all
        for batch in batches:
            key_type = batch.column(0).type
            for first, ends, ids in encode_all(batch.column(1), end_id):
                columns, begin, held = ([], [], [], [], [], []), 0, ids.tobytes()
                for doc_id, stop in zip(batch.column(0).slice(first, len(ends)).to_pylist(), ends.tolist()):
                    n, start = stop - begin, 0
                    for length in piece_lengths(n, limit):
                        piece = held[4 * (begin + start) : 4 * (begin + start + length)]
                        row = (doc_id, start, length, piece, n, length.bit_length() - 1)
                        for column, value in zip(columns, row):
                            column.append(value)
                        start += length
                    begin = stop
                types = (key_type, pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
                names = ("doc_id", "start", "length", "ids", "doc_tokens", "bucket")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return cut


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. ``limit`` is a power of two. A null or empty text is
    its end id alone, one piece. Repeated rows are packed once each. Null doc_ids stay null. An empty table gives no
    rows. ``sequence_id`` is unique over the table; its remainder by 32 is the bucket, the exponent of the length.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    source = docs.select("doc_id", "text")
    schema = _PIECES.format(key=source.schema["doc_id"].dataType.simpleString())
    pieces = source.mapInArrow(_cutter(vocabulary, end_id, limit), schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id() * 32 + F.col("bucket")).withColumn(
        "offset", F.lit(0).cast("bigint")
    )


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with checksums of their ids."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        F.col("length").cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )
