"""Quality of texts from how much better one of two zstandard dictionaries compresses them.

One dictionary is built from texts labelled good, one from texts labelled bad. A text's score is a logistic function of
the normalised difference of its two compressed sizes, with their normalised mean, the size without a dictionary and the
length beside it, fitted on labelled texts that built neither dictionary. Only texts enter a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fit's bounded sample: labelled texts of each class, and the longest text in it, in bytes.
SAMPLE_A_CLASS, LONGEST_SAMPLE = 4_000, 65_536
DICT_BYTES, CHUNK_BYTES, CHUNKS, LEVEL = 112_640, 1024, 8_000, 3
#: A document is predicted good from this score on.
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights over standardised features; without dictionaries every score is ``prior``."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def held_out(doc_id="doc_id"):
    """Rows that never teach: crc32 of the doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class _Measure:
    """Features of one text under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def packed(data: bytes | None):
            given = zstandard.ZstdCompressionDict(data) if data else None
            if given:
                given.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=False, write_dict_id=False)

        self.packs = [packed(good), packed(bad), packed(None)]

    def __call__(self, text: bytes) -> tuple[float, ...]:
        good, bad, plain = (len(p.compress(text)) for p in self.packs)
        n = len(text) + 1
        return (bad - good) / n, (good + bad) / (2 * n), (bad - good) / max(good, bad), plain / n, math.log(n)


def _dictionary(texts: list[bytes]) -> bytes:
    chunks = [t[i : i + CHUNK_BYTES] for t in texts for i in range(0, len(t), CHUNK_BYTES)]
    step = max(1, len(chunks) // CHUNKS)
    data = zstandard.train_dictionary(DICT_BYTES, [c for c in chunks[::step] if len(c) >= 8])
    return data.as_bytes()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression with an intercept, by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(z.shape[1]), 1e-3 * np.eye(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_A_CLASS, longest: int = LONGEST_SAMPLE) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, none longer than ``longest`` bytes, outside the held-out fold.

    The sample is the labelled ids of smallest hash. Null labels, ids and texts do not teach. With fewer than 20 texts
    of a class there is nothing to tell apart, and every score is the share of good labels (0.5 without any).
    """
    spark = docs.sparkSession
    named = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).select("doc_id", "quality").distinct()
    counts = {r.quality: r["count"] for r in named.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for quality, n in counts.items():
        ids = named.where(F.col("quality") == quality).withColumn("h", F.xxhash64("doc_id"))
        chosen = ids.orderBy("h", "doc_id").limit(per_class).select("doc_id")  # at most per_class rows
        fitting = docs.select("doc_id", "text").where("text is not null").where(F.octet_length("text") <= longest)
        rows = fitting.join(F.broadcast(chosen), "doc_id").limit(2 * per_class).collect()
        texts[quality] = [r.text.encode() for r in sorted(rows, key=lambda r: (r.doc_id * 2654435761 % 2**32, r.text))]
    if min(map(len, texts.values())) < 20:
        return Model(b"", b"", (), (), (), prior)
    try:
        good, bad = (_dictionary(texts[q][::2]) for q in (1, 0))
    except zstandard.ZstdError:  # too little text to build a dictionary from
        return Model(b"", b"", (), (), (), prior)
    measure = _Measure(good, bad)
    x, y, weight = [], [], []
    for quality, own in texts.items():
        rest = own[1::2]
        x += [measure(t) for t in rest]
        y += [quality] * len(rest)
        weight += [counts[quality] / len(rest)] * len(rest)
    values = np.array(x)
    mean, scale = values.mean(0), np.maximum(values.std(0), 1e-9)
    weights = _logistic((values - mean) / scale, np.array(y, float), np.array(weight) * len(y) / sum(weight))
    return Model(good, bad, tuple(mean), tuple(scale), tuple(weights), prior)


def _scorer(model: Model):
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = _Measure(model.good, model.bad) if model.weights else None
        mean, scale, weights = (np.array(v) for v in (model.mean, model.scale, model.weights))
        for batch in batches:
            if measure is None:
                yield pd.Series(np.full(len(batch), model.prior))
                continue
            x = np.array([measure((t or "").encode()) for t in batch]).reshape(len(batch), len(mean))
            z = weights[0] + ((x - mean) / scale) @ weights[1:]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(scores, "double")


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, higher for better texts.

    A null text scores as the empty one. Equal texts score alike. An empty table stays empty.
    """
    return docs.withColumn(name, _scorer(model)(F.col("text")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
