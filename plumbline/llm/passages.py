"""Repeated passages: paragraphs by MinHash bands, and passages inside paragraphs by the same idea on word windows.

Two kinds of passage are compared over all documents.

* Paragraphs with a five-word shingle: every line, and consecutive lines of less than ``LEAST_WORDS`` words joined up to
  a line without words. MinHash bands tuned for high recall gather them, exact Jaccard similarity of their five-word
  shingles confirms them, and links are clustered by components.
* Windows of ``LEAST_WORDS`` words anywhere in a text, as a passage may stand inside a line. A window's MinHash is the
  smallest hash of its shorter word runs, so equal windows share it. Windows whose smallest run two documents
  share are then compared by all their words.

Of each cluster of paragraphs one is kept: the joined lines or line by itself of the smallest (doc_id, start), and if
there is none, the first line inside joined lines that stay. The others are removals. Of each shared window
the copy of the smallest (doc_id, start) is kept, one that meets no removed paragraph if there is any; words of its other
copies are removals unless they belong to the kept copy of another window. So no window is removed everywhere but those
that meet a removed paragraph in all their copies, and of that paragraph a near copy is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.odd_minhash import Hashes, near_groups
from plumbline.llm.word_numbers import hashed, pieces, word_places
from plumbline.llm.words import forget, mixed
from plumbline.plans.materialize import materialize, release, settle

LEAST_WORDS, SHINGLE, THRESHOLD = 50, 5, 0.8
#: Lines of similarity 0.8 share a band with probability 1 - (1 - 0.8^3)^16, short of 1 by 1e-5.
BANDS, ROWS, SKETCH_FLOOR = 16, 3, 0.45
#: Words of the runs whose smallest hash stands for a window.
RUN = 25


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; none in a shorter text. Sums over doubling lengths, so long runs cost little."""
    n = len(hashes) - size + 1
    if n < 1:
        return hashes[:0]
    level, width, total, at = mixed(hashes), 1, np.zeros(n, dtype=np.uint64), 0
    while True:
        if size >> (width.bit_length() - 1) & 1:
            total = mixed(total + level[at : at + n])
            at += width
        if at == size:
            return total
        level = mixed(level[:-width] * np.uint64(0x9E3779B97F4A7C15) + level[width:])
        width *= 2


def window_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (the last of equals) of every ``width`` consecutive values; widths double."""
    n = len(values) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    least, place, held = values, np.arange(len(values)), 1
    while held < width:
        step = min(held, width - held)  # the last two windows overlap
        before = least[:-step] < least[step:]
        least, place = np.where(before, least[:-step], least[step:]), np.where(before, place[:-step], place[step:])
        held += step
    return place


def _batch(key, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *columns.values()], names=["doc_id", *columns])


def _smallest_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words stand one after another: hashes of all runs, windows within a text, their smallest runs' places."""
    runs = run_hashes(words, RUN)
    places = window_places(runs, LEAST_WORDS - RUN + 1)
    left = np.repeat(lengths.cumsum(), lengths)[: len(places)] - np.arange(len(places))  # words up to the text's end
    at = np.flatnonzero(left >= LEAST_WORDS)
    return runs, at, places[at]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window's smallest run: doc_id, start, hash."""
    for batch in batches:
        for piece, words, lengths in hashed(batch):
            runs, _, places = _smallest_runs(words, lengths)
            at = places[np.diff(places, prepend=-1) > 0]  # places never fall
            ends = lengths.cumsum()
            rows = np.searchsorted(ends, at, side="right")
            yield _batch(
                piece.column(0).take(pa.array(rows)),
                start=pa.array((at - (ends - lengths)[rows]).astype(np.int32)),
                hash=pa.array(runs[at].view(np.int64)),
            )
    forget()


def _listed(lists: pa.Array, each: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row of each ``each`` values of a column of lists, and all values; a null list is empty."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(counts)), counts // each), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose smallest run is shared: doc_id, start, hash of all words, cut (whether it meets a removed paragraph).

    Equal windows have the same smallest run at the same place in them, so no other window can be shared.
    Columns in: doc_id, text, starts of runs, starts and ends of removed paragraphs by turns (null without any).
    """
    for batch in batches:
        for piece, words, lengths in hashed(batch):
            ends = lengths.cumsum()
            heads = ends - lengths
            _, at, places = _smallest_runs(words, lengths)
            shared = np.zeros(len(words), dtype=bool)
            rows, starts = _listed(piece.column(2))
            inside = starts < lengths[rows]  # rows that repeat a doc_id have the runs of all their texts
            shared[(heads[rows] + starts)[inside]] = True
            at = at[shared[places]]
            lost = np.zeros(len(words) + 1, dtype=np.int64)
            rows, spans = _listed(piece.column(3), 2)
            spans = heads[rows, None] + np.minimum(spans.reshape(-1, 2), lengths[rows, None])
            np.add.at(lost, spans[:, 0], 1)
            np.add.at(lost, spans[:, 1], -1)
            lost = np.r_[0, (lost.cumsum() > 0).cumsum()]  # removed words before each place
            rows = np.searchsorted(ends, at, side="right")
            yield _batch(
                piece.column(0).take(pa.array(rows)),
                start=pa.array((at - heads[rows]).astype(np.int32)),
                hash=pa.array(run_hashes(words, LEAST_WORDS)[at].view(np.int64)),
                cut=pa.array(lost[at + LEAST_WORDS] > lost[at]),
            )
    forget()


def _runs_of(mask: np.ndarray) -> np.ndarray:
    """Begin and end of every run of true values."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).reshape(-1, 2)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept and removed spans of texts: doc_id, start, n_words, place of the kept copy of a removed span's first window.

    Columns in: doc_id, shared windows of the text (start, keep_doc, keep_start, own), own if it is the kept copy itself.
    """
    for batch in batches:
        lists = batch.column(1)
        windows, ends = lists.values, lists.offsets.to_numpy()
        start, own = windows.field("start").to_numpy(), windows.field("own").to_numpy(zero_copy_only=False)
        rows, starts, lengths, copies = [], [], [], []
        for i in range(len(batch)):
            here = np.arange(ends[i], ends[i + 1])
            here = here[np.argsort(start[here], kind="stable")]
            at, low = start[here].astype(np.int64), int(start[here[0]])
            marks = np.zeros((2, int(at[-1]) - low + LEAST_WORDS + 1), dtype=np.int64)
            for kind in (0, 1):
                chosen = at[own[here] == bool(kind)] - low
                np.add.at(marks[kind], chosen, 1)
                np.add.at(marks[kind], chosen + LEAST_WORDS, -1)
            gone, kept = marks.cumsum(axis=1)[:, :-1] > 0
            others = here[~own[here]]
            for begin, end in _runs_of(kept):
                rows.append(i), starts.append(low + begin), lengths.append(end - begin), copies.append(None)
            for begin, end in _runs_of(gone & ~kept):
                first = others[np.searchsorted(start[others] + LEAST_WORDS, low + begin, side="right")]
                rows.append(i), starts.append(low + begin), lengths.append(end - begin), copies.append(int(first))
        copies = pa.array(copies, pa.int64())
        yield _batch(
            batch.column(0).take(pa.array(rows, pa.int64())),
            start=pa.array(starts, pa.int32()),
            n_words=pa.array(lengths, pa.int64()),
            keep_doc=windows.field("keep_doc").take(copies),
            keep_start=windows.field("keep_start").take(copies),
        )


def _lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first byte, last byte + 1, first word and number of words of every line of texts as ``pieces`` gives them."""
    feeds, words = np.flatnonzero(data == ord("\n")), word_places(data, ends)[0]
    counts = np.bincount(np.searchsorted(ends, feeds, side="right") - 1, minlength=len(ends) - 1) + 1
    row, last = np.repeat(np.arange(len(counts)), counts), counts.cumsum() - 1
    inner = np.ones(len(row), dtype=bool)
    inner[last] = False
    begins, closes = np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
    closes[last], closes[inner] = ends[1:], feeds
    begins[last - counts + 1], begins[1:][inner[:-1]] = ends[:-1], feeds + 1
    before = np.searchsorted(words, begins)
    return row, begins, closes, before - np.searchsorted(words, ends[:-1])[row], np.searchsorted(words, closes) - before


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of ``SHINGLE`` words or more: doc_id, start in words, n_words, start and n_words of the joined lines around, text."""
    for batch in batches:
        for piece, data, ends in pieces(batch):
            row, begins, closes, at, n = _lines(data, ends)
            short = (n > 0) & (n < LEAST_WORDS)
            opens, shuts = short.copy(), short.copy()  # first and last of consecutive short lines of a text
            opens[1:] &= ~short[:-1] | (row[1:] != row[:-1])
            shuts[:-1] &= ~short[1:] | (row[1:] != row[:-1])
            head, tail = np.flatnonzero(opens), np.flatnonzero(shuts)
            total = at[tail] + n[tail] - at[head]
            joined = (opens.cumsum() - 1)[inner := np.flatnonzero(short & ~(opens & shuts))]
            alone = np.flatnonzero(n >= LEAST_WORDS)
            found = np.concatenate(
                [
                    [row[alone], at[alone], n[alone], at[alone], n[alone], begins[alone], closes[alone]],
                    [row[head], at[head], total, at[head], total, begins[head], closes[tail]],
                    [row[inner], at[inner], n[inner], at[head][joined], total[joined], begins[inner], closes[inner]],
                ],
                axis=1,
            )
            found = found[:, found[2] >= SHINGLE]
            held = data.tobytes()
            yield _batch(
                piece.column(0).take(pa.array(found[0])),
                start=pa.array(found[1].astype(np.int32)),
                n_words=pa.array(found[2]),
                top=pa.array(found[3].astype(np.int32)),
                top_words=pa.array(found[4]),
                text=pa.array([held[begin:close] for begin, close in zip(found[5].tolist(), found[6].tolist())], pa.string()),
            )
    forget()


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose hash stands in two documents or more."""
    counts = rows.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("hash")
    return rows.join(counts.hint("shuffle_hash"), "hash")


def repeated_paragraphs(docs: DataFrame, key: str) -> DataFrame:
    """Paragraphs with a near copy in another document: doc_id, start, n_words, kind, cluster_doc, cluster_start, kept.

    Lines inside joined lines that are removed, or that are kept for the same cluster, have no row.
    """
    place = f"doc_id {key}, start int, n_words bigint"
    paragraphs = docs.mapInArrow(_paragraphs, f"{place}, top int, top_words bigint, text string")
    node = F.struct("doc_id", "start", "n_words")
    groups = near_groups(paragraphs.select(node.alias("doc_id"), "text"), SHINGLE, THRESHOLD, Hashes(BANDS, ROWS), SKETCH_FLOOR, rounds=2)
    groups = materialize(groups.select(F.col("doc_id").alias("node"), "component_id"), "paragraph-groups")
    more = groups.groupBy("component_id").agg(F.min("node.doc_id").alias("a"), F.max("node.doc_id").alias("b")).where("a != b")
    around = paragraphs.select(node.alias("node"), "top", "top_words")
    found = groups.join(more.select("component_id"), "component_id").join(around, "node")
    whole = (F.col("node.start") == F.col("top")) & (F.col("node.n_words") == F.col("top_words"))
    found = found.select("component_id", "node.*", "top", "top_words", whole.alias("whole")).distinct()
    found = materialize(found, "near-paragraphs")

    # Joined lines and lines by themselves first, then the lines inside those that stay.
    first = found.where("whole").groupBy("component_id").agg(F.min(node).alias("first"))
    tops = found.where("whole").join(first, "component_id").groupBy("doc_id", "top").agg(
        F.max(node != F.col("first")).alias("cut"), F.max(node == F.col("first")).alias("leads")
    )
    no = F.lit(False)
    placed = found.join(tops, ["doc_id", "top"], "left").withColumns({"cut": F.coalesce("cut", no), "leads": F.coalesce("leads", no)})
    placed = materialize(placed.where("whole or not cut"), "paragraphs-left")
    keep = placed.groupBy("component_id").agg(F.min(F.struct((~F.col("whole")).alias("inside"), "doc_id", "start", "n_words")).alias("keep"))
    placed = placed.join(keep, "component_id")
    kept = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("start") == F.col("keep.start")) & (F.col("n_words") == F.col("keep.n_words"))
    same = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("top") == F.col("keep.start"))
    # Two kept paragraphs must not stand for lines of each other: the shorter one stands for lines of the longer one only.
    circular = F.col("leads") & (F.col("keep.n_words") >= F.col("top_words"))
    placed = placed.where(F.col("whole") | F.col("keep.inside") | ~(same | circular))
    return placed.select(
        "doc_id", "start", "n_words", F.lit("line").alias("kind"),
        F.col("keep.doc_id").alias("cluster_doc"), F.col("keep.start").alias("cluster_start"), kept.alias("kept"),
    ).distinct()


def _window_spans(docs: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Kept and removed spans of shared windows, as ``_spans`` gives them."""
    row = f"doc_id {key}, start int, hash bigint"
    runs = materialize(docs.mapInArrow(_runs, row), "runs")
    places = _shared(runs).groupBy("doc_id").agg(F.collect_list("start").alias("starts"))  # no more than a text's words
    span = F.array(F.col("start").cast("bigint"), F.col("start") + F.col("n_words"))
    lost = removed.groupBy("doc_id").agg(F.flatten(F.collect_list(span)).alias("removed"))  # no more than twice a text's lines
    around = docs.join(places.hint("shuffle_hash"), "doc_id").join(lost, "doc_id", "left").select("doc_id", "text", "starts", "removed")
    # Rows that repeat a doc_id may give a window twice; the smallest copy and the sets below take it once.
    windows = materialize(around.mapInArrow(_windows, row + ", cut boolean"), "windows")
    release(runs)
    copies = windows.groupBy("hash").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(F.struct("cut", "doc_id", "start")).alias("keep")
    )
    copies = copies.where("a != b").select("hash", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.start").alias("keep_start"))
    own = (F.col("doc_id") == F.col("keep_doc")) & (F.col("start") == F.col("keep_start"))
    placed = windows.join(copies.hint("shuffle_hash"), "hash").select("doc_id", F.struct("start", "keep_doc", "keep_start", own.alias("own")).alias("window"))
    texts = placed.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))  # no more than a text's words
    return texts.mapInArrow(_spans, f"doc_id {key}, start int, n_words bigint, keep_doc {key}, keep_start int")


def repeated_windows(docs: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Passages that stand word for word in another document: doc_id, start, n_words, cluster_doc, cluster_start.

    ``removed`` has the spans (doc_id, start, n_words) that go anyway. A cluster is a kept span; a removed span belongs
    to the one that holds the kept copy of its first window.
    """
    spans = settle(docs.sparkSession, lambda: _window_spans(docs, key, removed), "spans")
    kept = spans.where("keep_doc is null").select("doc_id", "start", "n_words")
    own = kept.withColumn("cluster_doc", F.col("doc_id")).withColumn("cluster_start", F.col("start"))
    holder = kept.select(F.col("doc_id").alias("cluster_doc"), F.col("start").alias("cluster_start"), F.col("n_words").alias("held"))
    inside = (F.col("keep_start") >= F.col("cluster_start")) & (F.col("keep_start") < F.col("cluster_start") + F.col("held"))
    gone = spans.where("keep_doc is not null").join(holder, (F.col("keep_doc") == F.col("cluster_doc")) & inside)
    return own.unionByName(gone.select(*own.columns))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per repeated passage: doc_id, start and n_words in words, kind (line, also for joined
    lines, or window), cluster_doc, cluster_start, kept.

    ``docs`` needs doc_id and text; other columns are not read. Words end at ASCII white space and A-Z are lowered. A
    document without a passage that another document repeats has no row; null and short texts have none. Rows with a
    null doc_id are left out. Rows that repeat a doc_id are one document. An empty table gives no rows. ``kept`` is
    true for the passage that stays of each cluster.
    """
    source = docs.where("doc_id is not null").select("doc_id", "text")
    key = source.schema["doc_id"].dataType.simpleString()
    kept = (F.col("doc_id") == F.col("cluster_doc")) & (F.col("start") == F.col("cluster_start"))
    # Tables of the way to the lines, and to the spans, take more disk than these; they go as soon as these are written.
    lines = settle(docs.sparkSession, lambda: repeated_paragraphs(source, key), "lines")
    windows = repeated_windows(source, key, lines.where("not kept").select("doc_id", "start", "n_words"))
    return lines.unionByName(windows.withColumn("kind", F.lit("window")).withColumn("kept", kept))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
