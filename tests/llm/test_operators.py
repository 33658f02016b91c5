"""Training-data operators on a small fixture with odd rows, against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import compress_quality, exact_index, html_text, license_scan, mixing, odd_minhash, packing, passages, token_store, tokens, vector_graph

WORDS = [f"word{i}" for i in range(400)]


def _text(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LONG = _text(7, 70)
TEXTS = {
    0: _text(1), 1: _text(1), 2: _text(1) + " tail", 3: None, 4: "", 5: "  \n\t", 6: "one",
    7: "Released under the MIT License.\nmore", 8: _text(2, 30) + " " + LONG + " " + _text(3, 30),
    9: _text(4, 20) + " " + LONG, 10: "a  b\n\nc é ÀÉ 'tis <|endoftext|> x y " * 3, 11: _text(5, 20_000),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), "x") for i, t in TEXTS.items()]
    rows.append((None, "no id", "en", "s0", 5, "x"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    return spark.createDataFrame(rows, schema)


def _plain_ids(name, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_whole_texts(name):
    odd = ["\n", " ", "a\n", "\na", " a", "a b\nC d. E,", "x\t y", "a  b", "ΑΣ ΑΣ. İ ǆ", "é ́x", "it's 12.5 ,, ..", "日本 語。"]
    for text in [*odd, *TEXTS.values()]:
        assert np.frombuffer(tokens.encoder(name).encode(text), "<u4").tolist() == _plain_ids(name, text)


def test_special_strings_follow_the_library():
    text = "a <|endoftext|> b!!"
    assert 50256 in np.frombuffer(tokens.Encoder("byte_bpe_50k.json").encode(text), "<u4")
    assert 50256 not in np.frombuffer(tokens.Encoder("byte_bpe_50k.json", special_as_text=True).encode(text), "<u4")


def test_old_words_leave_the_cache_without_a_trace(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    encoder = tokens.Encoder("word_bpe_49k.json")
    for text in [*TEXTS.values(), "a b c d e f a b c!! d?! (e) f", "a b a b x y z a"] * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == _plain_ids("word_bpe_49k.json", text)
        assert len(encoder.later) <= 3 and len(encoder.later.old) <= 3


def test_token_files_limited_in_rows_and_an_empty_table(spark, docs, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        token_store.write_tokens(docs, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = sorted(token_store.read_digest(spark, f"{tmp_path}/t").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at = 0
    for row in rows:
        assert row.start == at
        at += row.n_tokens
    token_store.write_tokens(docs.where("false"), f"{tmp_path}/none")
    assert token_store.read_digest(spark, f"{tmp_path}/none").collect() == []


def test_pieces_hold_every_id_once(docs):
    pieces = packing.digest(packing.pack(docs)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for doc_id, text in TEXTS.items():
        ids = [*_plain_ids(packing.VOCABULARY, text), packing.END_ID]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        at = 0
        for p in own:
            assert (p.start, p.offset) == (at, 0) and p.length & (p.length - 1) == 0 and p.length <= 2048
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length


def test_token_files_round_trip(spark, docs, tmp_path):
    token_store.write_tokens(docs, f"{tmp_path}/t")
    rows = {r.doc_id: r for r in token_store.read_digest(spark, f"{tmp_path}/t").collect()}
    at = rows[None].n_tokens
    for doc_id, text in TEXTS.items():
        ids = [*_plain_ids(token_store.VOCABULARY, text), token_store.END_ID]
        assert (rows[doc_id].start, rows[doc_id].n_tokens) == (at, len(ids))
        assert rows[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_exact_groups(docs):
    rows = {r.doc_id: r for r in exact_index.exact_groups(docs).collect()}
    assert (rows[0].keep_id, rows[1].keep_id, rows[1].kept) == (0, 0, False)
    assert {rows[i].keep_id for i in (3, 4, 5)} == {5} and rows[3].group_size == 3  # most code points
    assert exact_index.drop_exact_copies(docs).count() == docs.count() - 3


def test_directory_splits_until_all_fit():
    slots = exact_index.directory({0: 30, 1: 1, 5: 9}, capacity=10, max_depth=3)
    assert [s for s, _, _ in slots] == list(range(8))
    assert {b: d for _, b, d in slots}[0] == 3 and len({b for _, b, _ in slots}) == 4


def test_columns_of_texts_are_encoded_by_distinct_letters(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(11)
    letters = list("aAbÉéßİı数K.,!? \n\t '’0\r")
    texts = [None, "", "Word word, word! WORD\nword; (word) é É.", "a <|endoftext|> b", "one\nTwo"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(600)]
    monkeypatch.setattr(tokens, "GROUP_BYTES", 400)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder, found, groups = tokens.Encoder(name), [], 0
        for first, ends, ids in encoder.encode_all(pa.array(["before", *texts])[1:], 7):
            assert first == len(found)
            found += [part.tolist() for part in np.split(ids, ends)[:-1]]
            groups += 1
        assert groups > 1 and found == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    encoder = tokens.Encoder("word_bpe_49k.json")
    seen, merge = [], encoder.later.merge
    encoder.later.merge = lambda word: seen.append(word) or merge(word)
    list(encoder.encode_all(pa.array(["x Word word, word! WORD; word?"]), 7))
    assert seen.count("word") == 1 and not any(w != "word" and "word" in w for w in seen)


def test_near_groups_and_passages(docs):
    rows = {r.doc_id: r for r in odd_minhash.near_groups(docs).collect()}
    assert [rows[i].component_id for i in (0, 1, 2)] == [0, 0, 0]
    assert all(rows[i].kept and rows[i].n_shingles == 0 for i in (3, 4, 5)) and rows[6].n_shingles == 1
    found = passages.repeated_passages(docs).where("kind = 'window'").collect()
    spans = {r.doc_id: (r.start, r.n_words) for r in found}
    assert spans[8] == (30, 70) and spans[9] == (20, 70) and 11 not in spans


def test_signing_keeps_nothing_and_yields_small_groups(monkeypatch):
    import pyarrow as pa

    from plumbline.llm import words

    texts = [None, "", " ", "one", "Two words", "a a a A a a"] + [_text(i, 1 + 37 * i % 300) for i in range(60)] + ["last", None]
    monkeypatch.setattr(odd_minhash, "_GROUP", 400)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    hashes = odd_minhash.Hashes(4, 3)
    for size in (2, 5):
        signed = list(odd_minhash._signer(size, hashes)([batch]))
        assert not words._HASHES and len(signed) > 10 and max(sum(b.column(1).to_pylist()) for b in signed) < 400 + 300
        rows = [row for b in signed for row in b.to_pylist()]
        assert [row["doc_id"] for row in rows] == list(range(len(texts)))
        items = [row["items"] for b in odd_minhash._setter(size)([batch]) for row in b.to_pylist()]
        assert not words._HASHES
        for text, row, found in zip(texts, rows, items):
            own = (text or "").lower().split()
            runs = {tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()
            assert (len(runs), len(set(found)), row["class"] is None) == (row["n_shingles"], len(found), not own)
            assert len(found) == len(runs)
            if own:
                alone = odd_minhash.shingles(odd_minhash.hash_words(odd_minhash.split_words(text)), size)
                assert np.unique(alone).view(np.int64).tolist() == found
                best = (np.unique(alone)[:, None] * hashes.factors + hashes.added).min(axis=0)
                assert hashes.keys(best[None])[0].tolist() == row["bands"] and hashes.sketch(best[None])[0].tolist() == row["sketch"]
        words.forget()


def test_near_copies_leave_the_pipeline_without_a_shuffle_of_texts(spark, docs):
    import corpus_pipeline

    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    left = corpus_pipeline.near(spark, table, "")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    groups = {r.doc_id: r.kept for r in odd_minhash.near_groups(table, size=5).collect()}
    assert {r.doc_id for r in left.collect()} == {i for i, kept in groups.items() if kept}


def test_every_shared_window_keeps_one_copy(spark):
    a, b, x, y = (_text(seed, 60) for seed in (31, 32, 33, 34))
    tails = [_text(100 + i, 20) for i in range(9)]
    texts = {1: [a], 2: [a, b], 3: [a, b], 4: [x, a, y], 5: [x, a, y], 6: [y, b], 7: [b, y], 8: [a, a]}
    texts = {i: " ".join([tails[i], *parts, tails[i][::-1]]) for i, parts in texts.items()}
    found = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    gone = {(r.doc_id, k) for r in found if not r.kept for k in range(r.start, r.start + r.n_words)}
    places = {}
    for i, t in texts.items():
        words = t.split()
        for k in range(len(words) - 49):
            places.setdefault(tuple(words[k : k + 50]), []).append((i, k))
    shared = [p for p in places.values() if len({i for i, _ in p}) > 1]
    assert shared and gone
    for copies in shared:
        assert any(all((i, k + j) not in gone for j in range(50)) for i, k in copies)
    least = {min(p) for p in shared}
    stay = {(i, k + j) for i, k in least for j in range(50)}
    assert gone == {(i, k + j) for p in shared for i, k in p for j in range(50)} - stay


def test_only_windows_of_a_shared_run_become_rows():
    import pyarrow as pa

    text = _text(61, 400)
    runs = passages.run_hashes(odd_minhash.hash_words(odd_minhash.split_words(text)), passages.RUN)
    width = passages.LEAST_WORDS - passages.RUN + 1
    smallest = [max(range(k, k + width), key=lambda j: (-int(runs[j]), j)) for k in range(351)]
    assert passages.window_places(runs, width).tolist() == smallest
    shared = sorted(set(smallest))[3:6]
    columns = [pa.array([1, 2]), pa.array([text, "short"]), pa.array([shared, [0]], pa.list_(pa.int32())), pa.array([None, None], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "starts", "removed"])
    (found,) = passages._windows([batch])
    assert found.column(1).to_pylist() == [k for k in range(351) if smallest[k] in shared]
    assert set(found.column(0).to_pylist()) == {1} and not any(found.column(3).to_pylist())


def test_tables_of_the_way_to_passages_are_deleted(spark):
    import os

    from plumbline.plans.materialize import shared_folder

    text = _text(71, 90)
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    rows = [(1, text), (2, f"{text} tail"), (3, _text(72, 60)), (2, text)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert found and {name.split("-")[0] for name in set(os.listdir(folder)) - before} == {"lines", "spans"}


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from plumbline.plans import materialize as written

    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in held for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}
    before, setting = files(), spark.conf.get(written._CLEANUP, None)
    rows = spark.range(50_000).groupBy((F.col("id") % 997).alias("k")).agg(F.collect_list("id").alias("ids")).repartition(3, "ids")
    table = written.materialize(rows, "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(written._CLEANUP, None) == setting
    assert table.count() == 997
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in table.inputFiles()}
    written.release(table)
    assert not glob.glob(f"{path}*")


def test_words_of_columns_are_split_and_lowered_like_single_ones(monkeypatch):
    import pyarrow as pa

    from plumbline.llm import word_numbers
    from plumbline.llm.words import split_words

    long = "Lo" + "n" * 70
    texts = [None, "", " \t\n", "one", "two\x0bthree\x0c", "\x1cfour\xa0five \x85", "Ä ä A a", f"{long} x{long}", f" {long.lower()} ", "aab aba baa", "end", "end"]
    monkeypatch.setattr(word_numbers, "_PIECE", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    parts = list(word_numbers.hashed(batch))
    words = [word for text in texts for word in split_words(text)]
    assert len(parts) > 2 and [n for *_, lengths in parts for n in lengths.tolist()] == [len(split_words(text)) for text in texts[1:]]
    found = np.concatenate([numbers for _, numbers, _ in parts])
    assert found.tolist() == word_numbers.hash_words(words).tolist()
    assert len(set(found.tolist())) == len(set(words)) == len(set(zip(words, found.tolist())))


def test_paragraphs_of_a_column_are_those_of_its_lines():
    import pyarrow as pa

    six, fifty = "a b c D e f", _text(81, 50)
    texts = [None, f"\n{six}\r\nx\n\n{six} {six}\n", "", f"y\n{fifty}\n{six}", "a b c d", f"{six}\n \nz", "\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = {tuple(row.values()) for part in passages._paragraphs([batch]) for row in part.to_pylist()}
    assert found == {
        (1, 0, 7, 0, 7, f"{six}\r\nx"), (1, 0, 6, 0, 7, f"{six}\r"), (1, 7, 12, 7, 12, f"{six} {six}"),
        (3, 1, 50, 1, 50, fifty), (3, 51, 6, 51, 6, six), (5, 0, 6, 0, 6, six),
    }


def test_near_copies_of_short_and_joined_lines(spark):
    short, other, parts = _text(41, 20), _text(42, 30), [_text(50 + i, 25) for i in range(3)]
    edited = " ".join([*" ".join(parts).split()[:-1], "edited"])
    texts = {1: short, 2: f"{other}\n{short} more", 3: "\n".join(parts), 4: f"{edited}", 5: f"\n{_text(43, 4)}\n\n{short}", 6: _text(44, 60)}
    found = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    lines = {(r.doc_id, r.start, r.n_words, r.cluster_doc, r.cluster_start, r.kept) for r in found if r.kind == "line"}
    assert lines == {(1, 0, 20, 1, 0, True), (2, 30, 21, 1, 0, False), (5, 4, 20, 1, 0, False), (3, 0, 75, 3, 0, True), (4, 0, 75, 3, 0, False)}


def test_items_of_one_set_alone():
    rng = np.random.default_rng(9)
    for n, m in ((0, 0), (0, 3), (4, 0), (1, 1), (30, 40), (200, 7)):
        x, y = (np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)[rng.integers(0, 60, k)]) for k in (n, m))
        y = np.unique(np.r_[y, x[::2]]) if m else y
        first, second = odd_minhash._alone(x, y)
        assert first.tolist() == sorted(set(x.tolist()) - set(y.tolist())) and second.tolist() == sorted(set(y.tolist()) - set(x.tolist()))


def test_one_large_group_of_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    edits = [(int(rng.integers(0, 120)), f"common{k}") for k in range(12)]  # edits that several copies share
    texts = []
    for i in range(160):
        words = list(base)
        for place in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            words[place] = "" if rng.random() < 0.4 else f"own{i}-{place}"
        for k in rng.choice(12, int(rng.integers(0, 6)), replace=False):
            words[edits[k][0]] = edits[k][1]
        texts.append(" ".join(w for w in words if w))
    frame = spark.createDataFrame(list(enumerate(texts)) + [(7, "another text of the same id"), (9, None)], "doc_id int, text string")
    found = {r.doc_id: r.component_id for r in odd_minhash.near_groups(frame).collect()}
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))
    links = [(i, j) for i in least for j in least[:i] if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while True:
        before = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert 1 < len(set(least)) < len(texts)
    assert found == dict(enumerate(least))


def test_mix_takes_no_document_more_often_than_the_limit(spark):
    # The third source reaches three times its words; one source has none.
    rows = [(i, "a b c d" if i % 3 else "", "big", 7) for i in range(900)]
    rows += [(1000 + i, "a b" if i % 2 else None, None, 7) for i in range(40)] + [(2000 + i, " ", "empty", 7) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id int, text string, source string, cut int")
    table = table.withColumns({"__size": F.lit("s"), "__bin": F.lit("b"), "row": F.lit("r"), "whole": F.lit("w"), "__source": F.lit("o")})
    got = mixing.mix(table).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) == mixing.MOST_REPEATS
    assert all(r.copies == 3 for r in got if r.source is None) and all(r.copies == 0 and r.target == 0 for r in got if r.source == "empty")
    assert {(r["cut"], r["__size"], r["__bin"], r["row"], r["whole"], r["__source"]) for r in got} == {(7, "s", "b", "r", "w", "o")}


def test_mix_reaches_targets(docs):
    rows = mixing.mix(docs).collect()
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-6 and r.copies <= 3 for r in rows)
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in rows)


def test_licences(docs):
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (rows[7].n_base, rows[7].first_word, rows[7].labels, rows[7].n_words) == (1, 1, "mit", 6)
    assert rows[3].n_words == 0 and rows[3].labels == "" and len(rows) == docs.count()


def test_quality_without_labels_is_flat(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scored = compress_quality.score(docs.select("doc_id", "text"), compress_quality.fit(docs, labels)).collect()
    assert {r.score for r in scored} == {0.5}


def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scored = compress_quality.score(docs, compress_quality.fit(docs, labels)).join(labels, "doc_id").where(compress_quality.held_out())
    right = scored.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93


def test_shared_lines_are_deleted_outside_the_article(spark):
    menu = "<div>Menu</div><div>About us</div>"
    pages = [
        (1, "http://h/a/1", f"{menu}<p>First &amp; own</p><p>More</p>"), (2, "http://h/a/2", f"{menu}<p>Second own text</p>"),
        (3, "http://g/1", "<nav>x</nav><article><h1>T</h1><p>a <b>b</b><p>c<aside>no</aside></article>"), (4, None, None), (5, "bad", "<p>x"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert found[3] == "T\na b\nc" and found[4] == "" and found[5] == "x"
    assert found[1].endswith("First & own\nMore") and found[2].endswith("Second own text")


def test_differencing_looks_past_copies_and_through_heavy_templates():
    import pyarrow as pa

    def texts(pages):
        rows = [(i, f"http://h/{i}", html, "h", f"/{i}") for i, html in enumerate(pages)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["page_id", "url", "html", "host", "path"])
        return {r["page_id"]: r["text"] for b in html_text._texts(iter([batch])) for r in b.to_pylist()}

    menu = "<div>Menu of the site</div><div>Notice of the site</div>"
    own = [f"<p>{_text(70 + i, 30)}</p>" for i in range(6)]
    article = f"<article>{own[5]}</article>"
    found = texts([menu + own[0], menu + own[1], menu + own[1], article, menu + own[1], menu + own[1] + "<p>tail</p>", menu + own[2]])
    assert found[1] == found[2] == found[4] == own[1][3:-4] and found[5] == own[1][3:-4] + "\ntail"
    assert found[0] == own[0][3:-4] and found[3] == own[5][3:-4]
    heavy = "".join(f"<div>{_text(80 + i, 60)}</div>" for i in range(4))
    assert list(texts([heavy + x for x in own[:4]]).values())[1:3] == [own[1][3:-4], own[2][3:-4]]
    assert list(texts([heavy + own[0], heavy + own[1]]).values())[0].endswith(own[0][3:-4])  # two pages may be copies


def test_differencing_decides_open_lines_of_pages_with_an_article(spark):
    menu, foot = "<div>Menu of the site</div>", "<div>Notice of the site</div>"
    teaser = [f"<article><p>Teaser {_text(90 + i, 5)}</p></article>" for i in range(3)]
    story = [_text(95 + i, 60) for i in range(3)]
    quote, article = _text(98, 20), [_text(200 + i, 60) for i in range(3)]
    pages = [(i, f"http://a/{i}", f"{menu}{teaser[i]}<div>{story[i]}</div>{foot}") for i in range(3)]
    # A quote that every neighbour shares stays in the article; a remark around a longer article is none of the text.
    pages += [(10 + i, f"http://b/{i}", f"{menu}<article><p>{quote}</p><p>{article[i]}</p></article><div>remark {i}</div>{foot}") for i in range(3)]
    pages += [(20, "http://c/1", f"{menu}{teaser[0]}<div>{story[0]}</div>")]  # nothing to compare with
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    for i in range(3):
        assert found[i] == f"{teaser[i][12:-14]}\n{story[i]}"
        assert found[10 + i] == f"{quote}\n{article[i]}"
    assert found[20] == teaser[0][12:-14]


def test_alignment_is_longest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html_text.shared_lines(a, b)) == table[-1][-1]


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.05 * rng.normal(size=8)).tolist()) for i in range(5)] + [(i, rng.normal(size=8).tolist()) for i in range(5, 40)]
    rows += [(40, None), (41, [0.0] * 8), (42, [float("nan")] * 8), (43, rows[0][1]), (44, [])]
    found = {r.vec_id: r for r in vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    live = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if i not in (40, 41, 42, 44)}
    for i, x in live.items():
        assert found[i].n_links == sum(float(x @ y) >= 0.9 for j, y in live.items() if j != i)
    assert found[43].component_id == 0 and all(found[i].n_links == 0 for i in (40, 41, 42, 44))


def test_links_that_the_search_misses_are_found(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    rows += [(300 + i, (np.array(rows[i][1]) + 0.01 * rng.normal(size=16)).tolist()) for i in range(40)]
    monkeypatch.setattr(vector_graph, "_links", lambda nodes, *_: nodes.select(nodes.node.alias("u"), nodes.node.alias("v")).limit(0))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r.vec_id: r for r in vector_graph.near_vectors(frame).collect()}
    units = np.array([x for _, x in rows]) / np.linalg.norm([x for _, x in rows], axis=1)[:, None]
    counts = (units @ units.T >= 0.9).sum(axis=1) - 1
    assert counts.sum() >= 80 and all(found[i].n_links == counts[i] for i, _ in rows)
    assert all(found[300 + i].component_id == found[i].component_id for i in range(40))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for frame in (packing.pack(none), mixing.mix(none), license_scan.scan(none), exact_index.exact_groups(none), odd_minhash.near_groups(none), passages.repeated_passages(none)):
        assert frame.count() == 0
    assert vector_graph.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
