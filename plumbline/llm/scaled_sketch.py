"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

A text's shingles are its runs of five words. One fraction holds for all texts, so the sketch of a long text grows with
it, sketches merge by union, and the share of a short text's hashes that a long text holds too estimates containment
however unequal the two are. So that short texts do not end with an empty sketch, the smallest few hashes stay
whatever their value; what a sketch is complete up to follows from its hashes alone, and two sketches are compared up
to the smaller of the two bounds. A fingerprint is the ascending hashes as 16 hex digits each.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a shingle, one over the fraction of hashes retained, and hashes retained at least.
SIZE, SCALE, FLOOR = 5, 8, 16
#: Odd 62-bit multipliers of a shingle's words by place, taken from the golden ratio's powers.
PLACES = tuple((pow(0x9E3779B97F4A7C15, k, 1 << 64) >> 2) | 1 for k in range(1, SIZE + 1))
#: Hashed words that a worker keeps; beyond it the dictionary is emptied, which changes speed only.
CACHED_WORDS = 200_000
#: Bytes of text that one Arrow batch of results may stand for.
BATCH_BYTES = 8_000_000

_EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACES = np.array(PLACES, dtype=np.uint64)


class _Words(dict):
    """Word to the first 62 bits of its MD5."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big") >> 2
        return found


_WORDS = _Words()


def shingle_hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    r"""Distinct shingle hashes, ascending. Words are ``[^\x20\x09-\x0D]+`` with A-Z lowered; a text of fewer than
    ``size`` words is one shingle, one without words has none. A hash is the sum of place multiplier times word hash."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(hashes))
    n = len(hashes) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _PLACES[k]
    return np.unique(total)


def distill(hashes: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The hashes that a sketch retains of ascending distinct ones."""
    limit = np.uint64((1 << 64) // scale)
    return hashes[: max(int(np.searchsorted(hashes, limit)), floor)]


def sketch(text: str | None, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """Retained hashes of one text, ascending; none for a null text or one without words."""
    return distill(shingle_hashes(text), scale, floor)


def complete_up_to(own: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.uint64:
    """The hash up to which a sketch misses none: all if fewer than ``floor`` are there, else the fraction or its last hash."""
    if len(own) < floor:
        return _EVERY
    return max(np.uint64((1 << 64) // scale - 1), own[-1])


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> tuple[float, float]:
    """Estimated containment of the smaller of two shingle sets in the larger, and their resemblance (shared over all).

    Two empty sketches are alike (1, 1); an empty one is unlike any other (0, 0).
    """
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    bound = min(complete_up_to(a, scale, floor), complete_up_to(b, scale, floor))
    a, b = a[: np.searchsorted(a, bound, "right")], b[: np.searchsorted(b, bound, "right")]
    least = min(len(a), len(b))
    if not least:
        return 0.0, 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / least, shared / (len(a) + len(b) - shared)


def to_hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def from_hex(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint or ""), dtype=">u8").astype(np.uint64)


def fingerprint(text: str | Column) -> Column:
    """Fingerprint of a column of texts; empty for null texts and texts without words. Equal texts have equal ones."""

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: to_hex(sketch(t)), na_action=None)

    return made(text)


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated containment of the smaller text in the larger from two columns of fingerprints; null counts as empty."""

    @F.pandas_udf("double")
    def told(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([likeness(from_hex(x), from_hex(y))[0] for x, y in zip(left, right)], dtype=float)

    return told(a, b)


def merge(df: DataFrame, by: list[str], column: str = "fingerprint") -> DataFrame:
    """Fingerprint of all texts of each group together, from their fingerprints alone: ``by`` and ``column``.

    Hashes are distinct before they are gathered, so a group of copies of any size is one sketch; null fingerprints
    count as empty. The merged sketch of a group is one cell, as its answer has to be.
    """
    whole = F.coalesce(F.col(column), F.lit(""))
    hashes = F.explode_outer(F.regexp_extract_all(whole, F.lit("(.{16})"), 1)).alias("__hash")
    each = df.select(*by, hashes).distinct()
    # Hex digits of one width order as the numbers do.
    ends = f"{(1 << 64) // SCALE:016x}"
    held = each.groupBy(*by).agg(F.array_sort(F.collect_set("__hash")).alias("__all"))
    below = F.size(F.filter("__all", lambda h: h < ends))
    return held.select(*by, F.array_join(F.slice("__all", 1, F.greatest(below, F.lit(FLOOR))), "").alias(column))


def _ranged(docs: DataFrame, ranges: int | None) -> DataFrame:
    """Rows dealt into ranges of doc_id, sorted, each range ended by a copy of the first row of the next (``__border``).

    The last range ends with the first row of all. Only one id a range passes the driver.
    """
    spark = docs.sparkSession
    n = ranges or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id").repartitionByRange(n, "doc_id")
    firsts = ids.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id")).alias("s")).select("s.doc_id").collect()
    key = docs.schema["doc_id"].dataType
    cuts = sorted((r.doc_id for r in firsts), key=lambda v: (v is not None, v if v is not None else 0))
    known = [v for v in cuts if v is not None]
    shift = len(cuts) - len(known)

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bisect.bisect_right(known, v) - 1 + shift for v in batch], dtype="int32")

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("__hash", F.xxhash64("text"))
    # A batch of long ids with a null in it reaches pandas as floating point, so nulls are filled and placed apart.
    placed = place(F.coalesce("doc_id", F.lit(known[0]).cast(key))) if known else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(placed)
    own = rows.withColumns({"__range": at, "__border": F.lit(False)})
    before = [((k - 1) % len(cuts), v) for k, v in enumerate(cuts)] if cuts else []
    table = F.broadcast(spark.createDataFrame(before, f"__range int, __cut {key.simpleString()}"))  # one row a range
    border = rows.join(table, F.col("doc_id").eqNullSafe(F.col("__cut")))
    first = border.groupBy("__range").agg(F.min_by(F.struct("doc_id", "text", "__hash"), "__hash").alias("s"))
    ends = first.select("s.*", "__range", F.lit(True).alias("__border"))
    order = ("__range", "__border", "doc_id", "__hash")
    return own.unionByName(ends).repartitionById(max(1, len(cuts)), F.col("__range")).sortWithinPartitions(*order)


def _edited(text: str, after: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "resembles_edited", "resembles_next"]
    before = None
    for batch in batches:
        out, held = [], 0

        def flushed():
            types = [batch.column(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
            columns = zip(*out) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for doc_id, text, part, border in zip(
            batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ):
            text = text.as_py()
            own = sketch(text)
            if before is not None and before[0] == part:
                _, old_id, old, old_sketch = before
                edited = _edited(old, text)
                changed = old_sketch if edited == old else sketch(edited)
                near, after = likeness(old_sketch, changed), likeness(old_sketch, own)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                out.append((old_id, len(old), digest, to_hex(old_sketch), to_hex(changed), near[0], after[0], near[1], after[1]))
                held += len(old)
                if held >= BATCH_BYTES:
                    yield flushed()
                    out, held = [], 0
            before = None if border else (part, doc_id, text, own)
        yield flushed()


def compare_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and how like they and the next document's are.

    ``docs`` needs doc_id and text; other columns are not read. The edited text has the last quarter of its code points
    replaced by as many (or all) first ones of the next document in ascending doc_id, the last document's next being
    the first. Null ids come first; rows of one id are ordered by a hash of their text, so repeated rows are each
    other's next. Null texts count as empty. An empty table gives no rows; a single row is its own next. One shuffle of
    the texts; each task streams a range of ids, with one row of the next range beside it.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = _ranged(docs, ranges).select("doc_id", "text", "__range", "__border")
    fields = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double"
    more = "near_next double, resembles_edited double, resembles_next double"
    return rows.mapInArrow(_compared, f"doc_id {key}, {fields}, {more}")


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rid FROM documents
), paired AS (
  SELECT rid, doc_id, text, length(text) AS n,
    coalesce(lead(text) OVER (ORDER BY rid), first_value(text) OVER (ORDER BY rid)) AS after,
    coalesce(lead(rid) OVER (ORDER BY rid), 1) AS next_rid
  FROM base
), texts AS (
  SELECT rid, 0 AS kind, text FROM paired
  UNION ALL SELECT rid, 1, left(text, n - n // 4) || left(after, n // 4) FROM paired
), worded AS (
  SELECT rid, kind, text, list_transform(
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
    lambda w: (('0x' || left(md5(w), 16))::UBIGINT >> 2)::HUGEINT) AS w
  FROM texts
), hashed AS (
  SELECT rid, kind, text, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(
    range(1, greatest(len(w) - {SIZE - 1}, 1) + 1),
    lambda i: ((({" + ".join(f"coalesce(w[i + {k}], 0) * {c}::HUGEINT" for k, c in enumerate(PLACES))})
      % 18446744073709551616::HUGEINT)::UBIGINT)) END)) AS h
  FROM worded
), sketched AS (
  SELECT rid, kind, text, h[1 : greatest(len(list_filter(h, lambda x: x < {(1 << 64) // SCALE}::UBIGINT)), {FLOOR})] AS h
  FROM hashed
), bounded AS (
  SELECT *, CASE WHEN len(h) < {FLOOR} THEN {(1 << 64) - 1}::UBIGINT
    ELSE greatest({(1 << 64) // SCALE - 1}::UBIGINT, h[-1]) END AS bound,
    array_to_string(list_transform(h, lambda x: format('{{:016x}}', x)), '') AS fingerprint
  FROM sketched
), pairs AS (
  SELECT p.rid, 1 AS kind, a.h AS ah, b.h AS bh, least(a.bound, b.bound) AS bound
  FROM paired p JOIN bounded a ON a.rid = p.rid AND a.kind = 0 JOIN bounded b ON b.rid = p.rid AND b.kind = 1
  UNION ALL
  SELECT p.rid, 0, a.h, b.h, least(a.bound, b.bound)
  FROM paired p JOIN bounded a ON a.rid = p.rid AND a.kind = 0 JOIN bounded b ON b.rid = p.next_rid AND b.kind = 0
), cut AS (
  SELECT rid, kind, len(ah) = 0 AND len(bh) = 0 AS none, list_filter(ah, lambda x: x <= bound) AS ah,
    list_filter(bh, lambda x: x <= bound) AS bh FROM pairs
), shared AS (
  SELECT rid, kind, none, len(ah) AS a, len(bh) AS b, len(list_intersect(ah, bh)) AS s FROM cut
), near AS (
  SELECT rid, kind, CASE WHEN none THEN 1.0 WHEN least(a, b) = 0 THEN 0.0 ELSE s / least(a, b)::DOUBLE END AS contained,
    CASE WHEN none THEN 1.0 WHEN least(a, b) = 0 THEN 0.0 ELSE s / (a + b - s)::DOUBLE END AS resembles FROM shared
)
SELECT p.doc_id, p.n::BIGINT AS n_chars, sha256(e.text) AS edited_sha256, t.fingerprint,
  e.fingerprint AS edited_fingerprint, ne.contained::DOUBLE AS near_edited, nn.contained::DOUBLE AS near_next,
  ne.resembles::DOUBLE AS resembles_edited, nn.resembles::DOUBLE AS resembles_next
FROM paired p JOIN bounded t ON t.rid = p.rid AND t.kind = 0 JOIN bounded e ON e.rid = p.rid AND e.kind = 1
JOIN near ne ON ne.rid = p.rid AND ne.kind = 1 JOIN near nn ON nn.rid = p.rid AND nn.kind = 0
"""
