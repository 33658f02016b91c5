"""Records of delimited files whose quoted cells hold line breaks, cut in parallel.

A file is read as lines over many splits. Whether a split begins inside a quoted cell depends on everything before it,
so each split first tells how it ends if it begins outside and if it begins inside: two answers, from the lines with
quotes alone. Put one after another these tell the state at every split's beginning; then every split cuts its own
records, and a record that runs over a split's edge is joined from its pieces. No task reads a whole file.
"""

from __future__ import annotations

import csv
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

QUOTE = '"'


def _closed(line: str, at: int) -> int:
    """The place behind the quote that closes a cell whose content begins at ``at``; -1 if it stays open."""
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return -1
        if line[at + 1 : at + 2] != QUOTE:
            return at + 1
        at += 2


def ends_inside(line: str, inside: bool, sep: str = ",") -> tuple[bool, bool]:
    """Whether the line ends inside a quoted cell, and whether a cell open before it was closed.

    A quote opens a cell only as its first character; doubled quotes are content.
    """
    at, closed = 0, False
    if inside:
        at = _closed(line, 0)
        if at < 0:
            return True, False
        closed, at = True, line.find(sep, at)
        if at < 0:
            return False, True
        at += len(sep)
    while True:
        if not line.startswith(QUOTE, at):
            at = line.find(sep + QUOTE, at)
            if at < 0:
                return False, closed
            at += len(sep)
        at = _closed(line, at + 1)
        if at < 0:
            return True, closed
        at = line.find(sep, at)
        if at < 0:
            return False, closed
        at += len(sep)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    if encoding.upper().replace("_", "-") != "UTF-8":
        reader = reader.option("encoding", encoding)
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    return reader.text(path).select("value", *place)


def _split_ends(sep: str):
    """Per split: its end state from outside and from inside, whether a record open before it ends in it, and whether any
    line ends inside a cell if it begins outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, closes, breaks, inside, done = None, False, False, False, True, []
        for batch in batches:
            for line, path, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (path, start) != now:
                    if now is not None:
                        done.append((*now, out, inside, closes, breaks))
                    now, out, inside, closes, breaks = (path, start), False, True, False, False
                text = line.as_py()
                out, _ = ends_inside(text, out, sep)
                inside, _ = ends_inside(text, inside, sep)
                closes = closes or not inside
                breaks = breaks or out
        if now is not None:
            done.append((*now, out, inside, closes, breaks))
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_())
        names = ["path", "start", "out", "inside", "closes", "breaks"]
        columns = zip(*done) if done else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


@dataclass(frozen=True)
class Breaks:
    """Per file the splits that hold quotes, in order: where they start, whether they end inside a cell, and the split in
    which its record began. One entry a split."""

    starts: dict[str, list[int]]
    open: dict[str, list[tuple[bool, int]]]
    any: bool

    def at(self, path: str, start: int) -> tuple[bool, int]:
        """Whether a split begins inside a cell, and the split that opened it."""
        k = bisect_left(self.starts.get(path, []), start)
        return self.open[path][k - 1] if k else (False, -1)


def find_breaks(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> Breaks:
    """Where cells reach over lines; reads only lines with quotes in Python. One row a split reaches the driver."""
    quoted = _lines(spark, path, encoding).where(F.col("value").contains(QUOTE))
    schema = "path string, start bigint, out boolean, inside boolean, closes boolean, breaks boolean"
    starts, ends, found = {}, {}, False
    for r in sorted(quoted.mapInArrow(_split_ends(sep), schema).collect(), key=lambda r: (r.path, r.start)):
        own = ends.setdefault(r.path, [])
        inside, owner = own[-1] if own else (False, -1)
        end = r.inside if inside else r.out
        # While a record goes on, it belongs to the split that it began in.
        owner = owner if inside and end and not r.closes else r.start
        starts.setdefault(r.path, []).append(r.start)
        own.append((end, owner))
        found = found or r.breaks or inside
    return Breaks(starts, ends, found)


def _cutter(breaks: Breaks, sep: str):
    """Whole records, and pieces of records that reach over an edge; ``owner`` is null for whole ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, owner, held, first = None, False, -1, [], False

        def ended(rows):
            if held:
                rows.append((now[0], now[1], owner if owner >= 0 else now[1], "\n".join(held), first))

        for batch in batches:
            rows = []
            marked = pc.match_substring(batch.column(0), QUOTE).to_pylist()
            for line, path, start, has in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), marked):
                if (path, start) != now:
                    ended(rows)
                    now, held = (path, start), []
                    inside, owner = breaks.at(path, start)
                    first = start == 0
                    owner = owner if inside else -1
                text = line.as_py()
                if not has:
                    if inside:
                        held.append(text)
                    elif text.strip():
                        rows.append((path, start, None, text.removesuffix("\r"), first))
                        first = False
                    continue
                was, (inside, closed) = inside, ends_inside(text, inside, sep)
                if was and not closed:
                    held.append(text)
                    continue
                if was:
                    held.append(text)
                    if inside:  # closed one cell and opened another of the same record
                        continue
                    whole = "\n".join(held)
                    rows.append((path, start, owner if owner >= 0 else None, whole.removesuffix("\r"), first))
                    held, owner, first = [], -1, False
                elif inside:
                    held, owner = [text], -1
                else:
                    rows.append((path, start, None, text.removesuffix("\r"), first))
                    first = False
            yield _pieces(rows)
        rows = []
        ended(rows)
        yield _pieces(rows)

    return run


def _pieces(rows: list) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    columns = zip(*rows) if rows else [()] * 5
    names = ["path", "start", "owner", "record", "first"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def records(spark: SparkSession, path: str, breaks: Breaks, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """``record`` and ``first`` (it is the first of its file) of every record, blank lines left out."""
    schema = "path string, start bigint, owner bigint, record string, first boolean"
    cut = _lines(spark, path, encoding).mapInArrow(_cutter(breaks, sep), schema)
    edge = cut.where("owner IS NOT NULL").groupBy("path", "owner")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"])
    # One record a group: as many pieces as the splits it reaches over.
    joined = edge.agg(F.array_join(pieces, "\n").alias("record"), F.max("first").alias("first"))
    return cut.where("owner IS NULL").select("record", "first").unionByName(joined.select("record", "first"))


def header(found: DataFrame, sep: str = ",") -> list[str]:
    """Column names of a file's first record; empty and repeated names get their place, as Spark names them."""
    row = found.where("first").agg(F.min("record").alias("r")).first()
    if row.r is None:
        return []
    names = next(csv.reader([row.r.removeprefix("\ufeff")], delimiter=sep)) if "\n" not in row.r else next(
        csv.reader(row.r.removeprefix("\ufeff").splitlines(keepends=True), delimiter=sep)
    )
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]
