"""Near duplicates by MinHash bands, with odd sketches as the filter before exact confirmation.

A text is the set of its word shingles. Texts with equal sets are one class and only classes are compared. Band values
of MinHash samples gather classes in buckets. Three passes compare bucket members without comparing all pairs:

1. each member with its pivot, the one of all its bucket mates that meets most others;
2. members of one pivot that are not linked with it (outsiders) with the pivot's other members. Two sets differ where
   exactly one of them differs from the pivot, so such a pair must share a known number of differences from it. A prefix
   join over the differences, new shingles before missing ones, finds all such pairs;
3. in buckets whose members do not yet belong to one component, each member outside the bucket's largest component with
   the members of other components, unless the passes before compared the two.

After them no two members of a bucket are in different components without having been compared, so no component is
split. A comparison first folds both texts' samples into parity bitmaps (odd sketches): the population count of their
XOR tells high similarities apart from lower ones. What passes is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.word_numbers import hash_words, hashed
from plumbline.llm.words import forget, mixed, shingles, split_words
from plumbline.plans.materialize import materialize, release

#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^6)^40, short of 1 by 5e-6.
BANDS, ROWS = 40, 6
SKETCH_BITS = 512
SHINGLE, THRESHOLD = 2, 0.8
#: Estimated similarity below which a pair is not confirmed: six standard errors under the threshold or more.
SKETCH_FLOOR = 0.6
#: Words of the texts that are signed together.
_GROUP = 32_768


class Hashes:
    """``bands`` times ``rows`` hash functions with a fixed start, their band keys and their odd sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(20_240_801)
        self.bands, self.rows, n = bands, rows, bands * rows
        one, two = np.uint64(1), np.uint64(2)
        self.factors = rng.integers(1, 2**63, n, dtype=np.uint64) * two + one
        self.added = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.places = rng.integers(1, 2**63, n, dtype=np.uint64)

    def samples(self, unique: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The smallest value of each function over each set; sets stand one after another and begin at ``firsts``."""
        best, value = np.empty((len(firsts), len(self.factors)), dtype=np.uint64), np.empty_like(unique)
        for k, (factor, added) in enumerate(zip(self.factors, self.added)):
            np.multiply(unique, factor, out=value)
            np.add(value, added, out=value)
            best[:, k] = np.minimum.reduceat(value, firsts)
        return best

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One number for each set and band."""
        rows = samples.reshape(-1, self.bands, self.rows) * self.factors[: self.rows]
        return mixed(rows.sum(axis=2) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmap of each set's (function, sample) pairs as 64-bit numbers."""
        bits = mixed(samples ^ self.places) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
        bits = bits.astype(np.int64) + SKETCH_BITS * np.arange(len(samples))[:, None]
        odd = np.bincount(bits.ravel(), minlength=SKETCH_BITS * len(samples)) & 1
        return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view("<i8")

    def most_odd_bits(self, floor: float) -> int:
        """Population count of the XOR of two sketches at the estimated similarity ``floor``."""
        differ = 2 * len(self.factors) * (1 - floor)
        return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differ / SKETCH_BITS)))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, word hashes and lengths of consecutive texts, in groups of ``_GROUP`` words and one text more at most."""
    for piece, words, lengths in hashed(batch):
        ends, at = np.r_[0, lengths.cumsum()], 0
        while at < len(piece):
            last = min(int(np.searchsorted(ends, ends[at] + _GROUP)), at + _GROUP // 8, len(piece))
            yield piece.column(0).slice(at, last - at), words[ends[at] : ends[last]], lengths[at:last]
            at = last


def _sets(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingles of a group of texts, one after another and each sorted, and how many each text has."""
    counts = np.where(lengths < size, np.minimum(lengths, 1), lengths - size + 1)
    ends = counts.cumsum()
    found = np.zeros(int(ends[-1]), dtype=np.uint64)
    where = lengths.cumsum() - lengths
    if (lengths >= size).any():
        runs = shingles(words, size)  # those over the border of two texts are not taken
        whole = np.repeat(lengths >= size, counts)
        at = np.repeat(where - (ends - counts), counts) + np.arange(len(found))
        found[whole] = runs[at[whole]]
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):
        found[ends[i] - 1] = shingles(words[where[i] : where[i] + lengths[i]], size)[0]
    for begin, end in zip(ends - counts, ends):
        found[begin:end].sort()
    first = np.ones(len(found), dtype=bool)
    first[1:] = found[1:] != found[:-1]
    first[(ends - counts)[counts > 0]] = True
    text = np.repeat(np.arange(len(lengths)), counts)[first]
    return found[first], np.bincount(text, minlength=len(lengths))


def _lists(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A list for every valid place, null elsewhere."""
    offsets = np.r_[0, (valid * rows.shape[1]).cumsum()].astype(np.int32)
    nulls = pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=nulls)


def _signer(size: int, hashes: Hashes):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, lengths in _groups(batch):
                items, counts = _sets(words, lengths, size)
                valid = counts > 0
                ends = counts.cumsum()
                samples = hashes.samples(items, (ends - counts)[valid])
                held = memoryview(items.tobytes())
                classes = [hashlib.blake2b(held[8 * (e - n) : 8 * e], digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [keys, pa.array(counts, pa.int64()), pa.array(classes, pa.binary())]
                columns += [_lists(rows, valid) for rows in (hashes.keys(samples), hashes.sketch(samples))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "bands", "sketch"])
        forget()  # a worker waits for its next task beside a busy JVM

    return sign


def _setter(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, lengths in _groups(batch):
                items, counts = _sets(words, lengths, size)
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32)), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys, found], names=["rep", "items"])
        forget()

    return sets


def _alone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of one alone of two sorted sets: those of x, those of y."""
    if not len(x) or not len(y):
        return x, y
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both, rest = y[at] == x, np.ones(len(y), dtype=bool)
    rest[at[both]] = False
    return x[~both], y[rest]


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared and united items of two sets, and the items of one alone: those of u, sorted, then those of v, sorted."""
    for batch in batches:
        # Sets are sorted as numbers without a sign.
        sets = [(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
        alone = [[side.view(np.int64) for side in _alone(x, y)] for x, y in sets]
        shared = [len(x) - len(new) for (x, _), (new, _) in zip(sets, alone)]
        union = [len(y) + len(new) for (_, y), (new, _) in zip(sets, alone)]
        differences = pa.array([np.concatenate([np.sort(side) for side in both]) for both in alone], pa.list_(pa.int64()))
        columns = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64()), differences]
        yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "shared", "union", "differences"])


def _compared(pairs: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Full sets of pairs (u, v) of representatives held against each other: u, v, linked, differences."""
    wanted = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")
    key = docs.schema["doc_id"].dataType.simpleString()
    sets = materialize(texts.mapInArrow(_setter(size), f"rep {key}, items array<bigint>"), "sets")
    left, right = (sets.select(F.col("rep").alias(n), F.col("items").alias(f"{n}_items")) for n in ("u", "v"))
    held = pairs.join(left, "u").join(right, "v").select("u", "v", "u_items", "v_items")
    shared = held.mapInArrow(_sharing, f"u {key}, v {key}, shared bigint, union bigint, differences array<bigint>")
    linked = 100 * F.col("shared") >= round(100 * threshold) * F.col("union")
    return shared.select("u", "v", linked.alias("linked"), "differences")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of pairs (u, v) of representatives, those whose full sets have the similarity; u, v."""
    return _compared(pairs, docs, size, threshold).where("linked").select("u", "v").distinct()


def _alike(u: str, v: str, threshold: float, most: int):
    """Whether lengths and odd sketches of two classes allow the threshold."""
    bits = [F.bit_count(F.get(f"{u}_sketch", F.lit(k)).bitwiseXOR(F.get(f"{v}_sketch", F.lit(k)))) for k in range(SKETCH_BITS // 64)]
    sizes = F.col(f"{u}_n_shingles"), F.col(f"{v}_n_shingles")
    return (100 * F.least(*sizes) >= round(100 * threshold) * F.greatest(*sizes)) & (sum(bits[1:], bits[0]) <= most)


def _sketched(pairs: DataFrame, classes: DataFrame, threshold: float, most: int) -> DataFrame:
    """Pairs (u, v) whose lengths and odd sketches allow the threshold."""
    for name in ("u", "v"):
        own = [F.col(c).alias(f"{name}_{c}") for c in ("n_shingles", "sketch")]
        pairs = pairs.join(classes.select(F.col("rep").alias(name), *own), name)
    return pairs.where(_alike("u", "v", threshold, most)).select("u", "v")


def _around_pivots(compared: DataFrame, group: DataFrame, facts: DataFrame, threshold: float, most: int) -> DataFrame:
    """Pairs (u, v) in different components with one pivot, of which one at least is an outsider.

    Sets of n and m items that differ from the pivot's c items in a and b places differ from each other in a + b less
    twice the differences they share. Similarity p percent allows r (n + m) places with r = (100 - p) / (100 + p), so
    they share at least (a + b - r (n + m)) / 2. An outsider has b > r (m + c), which leaves more than
    (a + r (c - n)) / 2 for its partner; and as no more than b can be shared, at least a - r (n + m) for the outsider.
    """
    p = round(100 * threshold)
    ratio = F.lit((100 - p) / (100 + p))
    away = compared.where("not linked").select("v").distinct()
    known = compared.join(away, "v").join(facts.withColumnRenamed("rep", "u"), "u")
    known = known.join(facts.select(F.col("rep").alias("v"), F.col("n_shingles").alias("c")), "v")
    known = known.join(group.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    known = known.withColumn("a", F.size("differences").cast("bigint"))
    longest = known.groupBy("v").agg(F.max("n_shingles").alias("longest"))
    known = materialize(known.join(longest, "v"), "around-pivots")

    def prefixes(name: str, rows: DataFrame, least) -> DataFrame:
        length = F.col("a") - F.greatest(F.lit(1), F.ceil(least - 1e-6)) + 1
        kept = [F.col(c).alias(f"{name}_{c}") for c in ("u", "a", "linked", "component", "n_shingles", "sketch")]
        item = F.posexplode(F.slice("differences", F.lit(1), F.greatest(F.lit(0), length).cast("int"))).alias(f"{name}_at", "item")
        return rows.select("v", *kept, item)

    n, c, a = F.col("n_shingles"), F.col("c"), F.col("a")
    outsiders = prefixes("x", known.where("not linked"), a - ratio * (n + F.col("longest")))
    others = prefixes("y", known, (a + ratio * (c - n)) / 2)
    need = (F.col("x_a") + F.col("y_a") - ratio * (F.col("x_n_shingles") + F.col("y_n_shingles"))) / 2 - 1e-6
    left = F.least(F.col("x_a") - F.col("x_at"), F.col("y_a") - F.col("y_at"))  # shared from the first shared item on
    once = F.col("y_linked") | (F.col("x_u") < F.col("y_u"))
    new = (F.col("x_component") != F.col("y_component")) & once & (left >= need)
    met = outsiders.join(others, ["v", "item"]).where(new & _alike("x", "y", threshold, most))
    return met.select(F.least("x_u", "y_u").alias("u"), F.greatest("x_u", "y_u").alias("v")).distinct()


def near_groups(
    docs: DataFrame,
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    hashes: Hashes | None = None,
    floor: float = SKETCH_FLOOR,
    rounds: int = 1,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``rounds``: buckets of so many shares of the bands are gathered one after another, which takes less disk at once.

    ``docs`` needs doc_id and text; other columns are not read. A text without words is linked with nothing. Equal sets
    are always linked. Rows with a null doc_id are not linked; their component is null. Rows that repeat a doc_id are
    one node and share its component. An empty table gives no rows.
    """
    hashes = hashes or Hashes()
    most = hashes.most_odd_bits(floor)
    source = docs.select("doc_id", "text")
    key = source.schema["doc_id"].dataType.simpleString()
    signed = source.mapInArrow(_signer(size, hashes), f"doc_id {key}, n_shingles bigint, class binary, bands array<bigint>, sketch array<bigint>")
    signed = materialize(signed, "signed")
    named = signed.where("class is not null and doc_id is not null")
    classes = named.groupBy("class").agg(F.min_by(F.struct("doc_id", "n_shingles", "sketch", "bands"), "doc_id").alias("best"))
    classes = materialize(
        classes.select("class", F.col("best.doc_id").alias("rep"), "best.n_shingles", "best.sketch", "best.bands"), "classes"
    )
    # Each row with the class it is in; wide rows go as soon as they have been read for the last time.
    own = signed.select("doc_id", "n_shingles", "class").join(classes.select("class", "rep").hint("shuffle_hash"), "class", "left")
    own = materialize(own.select("doc_id", "n_shingles", "class", F.coalesce("rep", "doc_id").alias("rep")), "own")
    release(signed)
    parts = []
    for bands in np.array_split(np.arange(hashes.bands), rounds):
        # One exchange serves the count, which reads rep for that, and the join.
        part = classes.select("rep", F.explode(F.slice("bands", int(bands[0]) + 1, len(bands))).alias("band")).repartition("band")
        crowded = part.groupBy("band").agg(F.count("rep").alias("n")).where("n > 1")
        parts.append(materialize(part.join(crowded.hint("shuffle_hash"), "band"), "members"))
    members = reduce(DataFrame.unionByName, parts)
    # The original of many copies meets more of them than any copy does, so it is the best centre of a star.
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    centres = members.join(met, "rep").groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("met"), "rep")).alias("best"))
    members = materialize(members.select("band", "rep").join(centres, "band"), "stars")
    facts = classes.select("rep", "n_shingles", "sketch").join(members.select("rep").distinct().hint("shuffle_hash"), "rep", "left_semi")
    facts = materialize(facts, "facts")  # of classes in buckets; no other is looked up
    release(classes)

    # First pass: one pair a member, with the best centre of its buckets; later passes do not rely on the choice.
    stars = members.groupBy("rep").agg(F.min("best").alias("best")).select(F.col("rep").alias("u"), F.col("best.rep").alias("v"))
    stars = materialize(_sketched(stars.where("u != v"), facts, threshold, most), "pairs")
    compared = materialize(_compared(stars, source, size, threshold), "compared")
    links = compared.where("linked").select("u", "v").distinct()
    # A doc_id with several texts has several sets, so its differences from a pivot mean nothing: the third pass takes it.
    text_class = F.coalesce("class", F.lit(b""))
    repeated = materialize(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    several = own.join(repeated, "doc_id").groupBy("doc_id").agg(F.min(text_class).alias("one"), F.max(text_class).alias("other"))
    several = materialize(several.where("one != other").select("doc_id"), "several-texts")
    plain = stars.join(several.withColumnRenamed("doc_id", "u"), "u", "left_anti").join(several.withColumnRenamed("doc_id", "v"), "v", "left_anti")
    plain = materialize(plain.select("u", "v"), "plain-pairs")

    # Second pass: outsiders and the other members of their pivot.
    group = components(links)
    around = materialize(_around_pivots(compared.join(plain, ["u", "v"]).dropDuplicates(["u", "v"]), group, facts, threshold, most), "pivot-pairs")
    if not around.isEmpty():
        links = materialize(links.unionByName(_confirmed(around, source, size, threshold)), "confirmed")
        group = components(links)

    # Third pass: what a bucket's members still leave apart.
    placed = members.select("band", "rep").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    placed = materialize(placed.select("band", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    apart = placed.join(main.where("parts > 1").drop("parts"), "band").join(facts, "rep")
    apart = materialize(apart.join(plain.select(F.col("u").alias("rep"), F.col("v").alias("pivot")), "rep", "left"), "apart")
    outside, others = (
        apart.select("band", *[F.col(c).alias(f"{n}_{c}") for c in ("rep", "component", "n_shingles", "sketch", "pivot")], *more)
        for n, more in (("x", ["main"]), ("y", []))
    )
    new = (F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("main")) | (F.col("x_rep") < F.col("y_rep")))
    before = [F.coalesce(F.col(one) == F.col(other), F.lit(False)) for one, other in (("x_pivot", "y_pivot"), ("x_pivot", "y_rep"), ("x_rep", "y_pivot"))]
    new &= ~(before[0] | before[1] | before[2])
    pairs = outside.where("x_component != main").join(others, "band").where(new & _alike("x", "y", threshold, most))
    pairs = pairs.select(F.least("x_rep", "y_rep").alias("u"), F.greatest("x_rep", "y_rep").alias("v")).distinct()
    late = materialize(pairs, "late-pairs")
    if not late.isEmpty():
        links = links.unionByName(_confirmed(late, source, size, threshold))
        group = components(links)

    placed = own.where("doc_id is not null").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    found = placed.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    unnamed = own.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(unnamed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies over all documents."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
