"""Delimited files with line breaks in cells, over many small splits, against Python's csv module."""

import csv
import io
import random

import pytest

from plumbline.sources import files
from plumbline.sources.records import ends_inside, find_breaks, header, records

CELLS = ["a", "", "x y", 'say "hi"', "two\nlines", "\n", "end\n", "\n\n", 'q"\n"q', ";,", "é日本\nx", ' "x', "1", "tail\r\nnext", '"', '""', "," * 9]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _file(path, rows, end="\n", sep=","):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_python(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n"])
    for k in range(3):
        rows = [["id", "left", "right"]]
        rows += [[f"{k}-{i}", rng.choice(CELLS), rng.choice(CELLS) * rng.choice([1, 1, 1, 30])] for i in range(60)]
        _file(tmp_path / f"f{k}.csv", rows, end)
    got = files.read_delimited(spark, str(tmp_path), na_tokens=())
    assert got.columns == ["id", "left", "right"]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    want = []
    for k in range(3):
        with open(tmp_path / f"f{k}.csv", newline="", encoding="utf-8") as file:
            want += [tuple(r) for r in list(csv.reader(file))[1:]]
    assert sorted(tuple(c or "" for c in r) for r in got.collect()) == sorted(want)


def test_states_of_a_line():
    assert ends_inside('1,"a', False) == (True, False)
    assert ends_inside('b",2', True) == (False, True)
    assert ends_inside('b",2,"c', True) == (True, True)
    assert ends_inside('1,5" pipe,2', False) == (False, False)
    assert ends_inside('no quote', True) == (True, False)
    assert ends_inside('say ""hi"" ', True) == (True, False)
    assert ends_inside('"a""b","c"', False) == (False, False)
    assert ends_inside('"a"|"c', False, "|") == (True, False)


def test_header_with_line_break_and_repeats(spark, small_splits, tmp_path):
    _file(tmp_path / "h.csv", [["a\nb", "c", "C", ""], ["1", "2", "x\ny", "4"], [" 5", "6", "7", ""]])
    df = files.read_delimited(spark, str(tmp_path))
    assert df.columns == ["a\nb", "c1", "C2", "_c3"]
    assert sorted(map(tuple, df.collect())) == [(1, 2, "x\ny", 4.0), (5, 6, "7", None)]


def test_plain_files_do_not_enter_python(spark, tmp_path):
    _file(tmp_path / "p.csv", [["a", "b"], ["1", 'x "y"'], ["2", "5, 6"]])
    assert not find_breaks(spark, str(tmp_path)).any
    df = files.read_delimited(spark, str(tmp_path))
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == [(1, 'x "y"'), (2, "5, 6")]


def test_delimiter_is_counted_outside_quotes(spark, tmp_path):
    _file(tmp_path / "s.csv", [["a", "b"], ["1,5;7", "x\ny;z"], ["2", "3,4,5"]], sep=";")
    assert files.sniff_delimiter(spark, str(tmp_path)) == ";"
    assert sorted(files.read_delimited(spark, str(tmp_path), sep=None).collect()) == [("1,5;7", "x\ny;z"), ("2", "3,4,5")]


def test_documents_survive_a_round_trip(spark, small_splits, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    odd = [(9001, None, ""), (9002, "", None), (9003, " outer ", "\t"), (9004, "a\r\nb\rc\n", '"'), (9005, "\n", '""')]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    files.write_delimited(docs.repartition(3), f"{tmp_path}/out")
    back = files.read_delimited(spark, f"{tmp_path}/out", schema=docs.schema, na_tokens=())
    assert back.exceptAll(docs).count() == docs.exceptAll(back).count() == 0 and back.count() == docs.count()
    found = records(spark, f"{tmp_path}/out", find_breaks(spark, f"{tmp_path}/out"))
    assert found.where("first").count() == 3 and header(found) == docs.columns


def test_documents_with_line_breaks_are_written_by_as_many_tasks_as_they_are_read(spark, tmp_path):
    from checks.report import csv_line_breaks

    rows = [(i, "two\nlines, \"q\"" if i % 2 else f"text {i}") for i in range(64)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found = csv_line_breaks(spark, str(tmp_path))
        assert len(found.inputFiles()) >= 12  # four before, whatever the size
        assert sorted(map(tuple, found.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
