"""Mixing sources to target weights with DataFrame functions only.

One scan sums words per source and hash bin; targets, repetition rates and the cut of each source come from that small
table. A second scan emits every document floor(rate) times and one more time if its seeded hash lies under the cut.
The cut is the bin border at which the extra words come nearest to their share, so the probability of the extra copy is
the fraction of the rate, and long documents cannot push a source far from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.materialize import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_REPEATS, SEED = (1, 2, 3), 3, "mix-1"
#: Hash bins a source; the cut is exact to half a bin.
BIN_BITS = 12
#: Source tables above this many rows are joined without a broadcast.
BROADCAST_SOURCES = 50_000


def _sized(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """Source, __size, __bin and ``more`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10)
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    return docs.select("source", size.alias("__size"), F.shiftright(drawn.cast("bigint"), 32 - BIN_BITS).cast("int").alias("__bin"), *more)


def source_rates(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Per source: source, source_size, target, whole copies and the cut: the number of hash bins that get one copy more.

    A source whose target is a whole multiple of its size has no cut, so documents without words get no copy more either.

    Sources stand in order of code point, null last, and take the weights in turn. Targets share all words by weight;
    none exceeds ``most`` times its source, and the excess is shared again. The work beyond the first aggregation is on
    one row per source and bin.
    """
    bins = materialize(_sized(docs, seed).groupBy("source", "__bin").agg(F.sum("__size").alias("size")), "mix-bins")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    filled = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    up_to = filled.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cap = F.lit(most) * F.col("source_size")
    # Sources fill up in order of cap by weight; those before the first that keeps below its cap are capped.
    sources = sources.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "caps": F.sum(cap).over(up_to) - cap,
            "weights": F.sum("weight").over(every) - F.sum("weight").over(up_to) + F.col("weight"),
        }
    )
    capped = cap.cast("double") * F.col("weights") <= (F.col("total") - F.col("caps")).cast("double") * F.col("weight")
    sources = sources.withColumn("capped", capped).withColumns(
        {
            "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(every), F.lit(0)),
            "open": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every),
        }
    )
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("left").cast("double") * F.col("weight") / F.col("open"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = sources.select("source", "source_size", target.alias("target")).withColumn("whole", F.floor(rate).cast("int"))
    extra = F.col("target") - F.col("whole") * F.col("source_size")
    rates = rates.withColumn("extra", extra)
    before = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.sum("size").over(before) - F.col("size") / 2
    cuts = (
        bins.withColumn("reached", reached)
        .alias("b")
        .join(rates.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")))
        .groupBy("r.source", "source_size", "target", "whole")
        .agg(F.coalesce(F.max(F.when((F.col("extra") > 0) & (F.col("reached") <= F.col("extra")), F.col("__bin") + 1)), F.lit(0)).alias("cut"))
    )
    return materialize(cuts, "mix-rates")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes the document.

    Needs doc_id, text and source; columns of these four names are replaced, all others kept whatever their names. A null text has size 0. A null source is
    a source of its own, last in order. Null doc_ids draw as one document; rows that repeat a doc_id draw alike. A
    source without words has target 0. An empty table gives no rows. Reruns agree.
    """
    rates = source_rates(docs, weights, most, seed).withColumnRenamed("source", "__source")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rows = _sized(docs, seed, F.struct(*own).alias("row")).join(rates, F.col("source").eqNullSafe(F.col("__source")))
    copies = (F.col("whole") + (F.col("__bin") < F.col("cut")).cast("int")).cast("bigint")
    return rows.select("row.*", F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for every copy that the mix takes."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of all documents."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies", "source")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> {32 - BIN_BITS})::INTEGER AS bin
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    (sum({MOST_REPEATS} * source_size) OVER f - {MOST_REPEATS} * source_size)::BIGINT AS caps,
    (sum(weight) OVER () - sum(weight) OVER f + weight)::BIGINT AS weights
  FROM sources
  WINDOW f AS (ORDER BY {MOST_REPEATS} * source_size::DOUBLE / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), capped AS (
  SELECT *, ({MOST_REPEATS} * source_size)::DOUBLE * weights <= (total - caps)::DOUBLE * weight AS capped FROM filled
), rest AS (
  SELECT *, total - coalesce(sum({MOST_REPEATS} * source_size) FILTER (WHERE capped) OVER (), 0)::BIGINT AS left_over,
    (sum(weight) FILTER (WHERE NOT capped) OVER ())::BIGINT AS open FROM capped
), rates AS (
  SELECT source, source_size,
    CASE WHEN capped THEN ({MOST_REPEATS} * source_size)::DOUBLE ELSE left_over::DOUBLE * weight / open END AS target
  FROM rest
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 0 END AS whole FROM rates
), bins AS (
  SELECT source, bin, sum(size)::BIGINT AS size FROM sized GROUP BY source, bin
), reached AS (
  SELECT source, bin, (sum(size) OVER (PARTITION BY source ORDER BY bin ROWS UNBOUNDED PRECEDING))::DOUBLE - size / 2 AS reached
  FROM bins
), cuts AS (
  SELECT w.source, w.source_size, w.target, w.whole,
    coalesce(max(r.bin + 1) FILTER (WHERE w.target > w.whole * w.source_size AND r.reached <= w.target - w.whole * w.source_size), 0) AS cut
  FROM whole w JOIN reached r ON r.source IS NOT DISTINCT FROM w.source
  GROUP BY w.source, w.source_size, w.target, w.whole
)
SELECT s.doc_id, s.size, c.source_size, c.target, (s.size * (c.whole + (s.bin < c.cut)::INTEGER))::BIGINT AS taken,
  (c.whole + (s.bin < c.cut)::INTEGER)::BIGINT AS copies, s.source
FROM sized s JOIN cuts c ON c.source IS NOT DISTINCT FROM s.source
"""
