"""Threshold-scaled sketches, conversation repair and whitening on odd rows, against brute force."""

import hashlib
import random
from functools import cache

import numpy as np
import pytest

from plumbline.llm import dialogue, scaled_sketch, whitening

DOCS = {
    3: "One two three four five six seven eight nine ten eleven twelve", 1: None, 2: "", 7: " \t\n", 9: "word", 5: "word",
    8: "ÀÉ a b c d e f g 日本 語。 " * 40, 6: " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000)), 4: "a b c",
}


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1.0) for i, t in DOCS.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, __hash double").repartition(3)


@pytest.mark.parametrize("ranges", [1, 2, 20])
def test_neighbours_over_any_ranges(docs, ranges):
    got = {r.doc_id: r for r in scaled_sketch.compare_neighbours(docs, ranges).collect()}
    ids = sorted(DOCS)
    assert sorted(got) == ids
    for here, there in zip(ids, ids[1:] + ids[:1]):
        text, after = DOCS[here] or "", DOCS[there] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = got[here]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == scaled_sketch.to_hex(scaled_sketch.sketch(text))
        for other, near, resembles in ((edited, row.near_edited, row.resembles_edited), (after, row.near_next, row.resembles_next)):
            a, b = _shingles(text), _shingles(other)
            true = len(a & b) / min(len(a), len(b)) if a and b else float(a == b)
            assert near == pytest.approx(true, abs=0.1)
            assert 0 <= resembles <= near <= 1
    assert got[9].fingerprint == got[5].fingerprint != ""


def test_neighbours_of_null_and_repeated_ids(spark):
    rows = [(None, "x y"), (None, "x y"), (2**60 + 1, "b"), (2**60, "a"), (2**60, "a")]
    one = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in scaled_sketch.compare_neighbours(one, 3).collect()) == sorted(str(i) for i, _ in rows)
    only = scaled_sketch.compare_neighbours(one.where("text = 'b'")).collect()
    assert [(r.doc_id, r.near_next, r.near_edited) for r in only] == [(2**60 + 1, 1.0, 1.0)]
    assert scaled_sketch.compare_neighbours(one.where("false")).collect() == []
    assert scaled_sketch.compare_neighbours(one.where("doc_id is null")).count() == 2
    named = one.selectExpr("cast(doc_id as string) doc_id", "text")
    assert scaled_sketch.compare_neighbours(named, 3).count() == 5


def test_sketches_merge_and_contain():
    long, part = [f"t{i}" for i in range(6000)], [f"t{i}" for i in range(1000, 1300)]
    a, b = scaled_sketch.sketch(" ".join(long)), scaled_sketch.sketch(" ".join(part))
    assert scaled_sketch.likeness(a, b)[0] == 1.0 and scaled_sketch.likeness(a, b)[1] < 0.12
    assert len(a) == pytest.approx(6000 / scaled_sketch.SCALE, rel=0.15)
    few = scaled_sketch.sketch("only a few words stand here for once")
    assert len(few) == 4 and scaled_sketch.likeness(few, few) == (1.0, 1.0)


def test_merged_fingerprints_equal_those_of_all_shingles(spark):
    texts = ["a b c d e f g h i", "c d e f g h i j k l m n o p q r s t u v w x y z " * 2, " ".join(map(str, range(900))), None, ""]
    df = spark.createDataFrame([(g, t) for g in ("x", "y", None) for t in texts[: 2 + 3 * (g == "x")]], "g string, text string")
    df = df.withColumn("fingerprint", scaled_sketch.fingerprint("text"))
    got = {r.g: r.fingerprint for r in scaled_sketch.merge(df, ["g"]).collect()}
    whole = lambda some: np.unique(np.concatenate([scaled_sketch.shingle_hashes(t) for t in some]))
    for g, some in (("x", texts), ("y", texts[:2]), (None, texts[:2])):
        assert got[g] == scaled_sketch.to_hex(scaled_sketch.distill(whole(some)))
    pair = df.where("g = 'x'").withColumn("c", scaled_sketch.containment("fingerprint", "fingerprint"))
    assert {r.c for r in pair.collect()} == {1.0}


def _cheapest(rows):
    """Least cost and audit by search from the end; rows are (role code, fault code)."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    @cache
    def here(i, state):
        if i == len(rows):
            return (0, "") if state in (0, 3) else (10**9, "")
        role, fault = rows[i]
        ways = [(3, "D", state)]
        if fault < 2:
            ways.append((2 + fault, "R", after[state]))
            kept = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}.get(role, {}).get(state)
            if kept is not None:
                ways.append((fault, "K", kept))
        return min((c + inserted(i + 1, to)[0], e + inserted(i + 1, to)[1]) for c, e, to in ways)

    @cache
    def inserted(i, state):
        ways = [here(i, state)]
        for n in (1, 2):
            state = after[state]
            cost, audit = here(i, state)
            ways.append((cost + 2 * n, "I" * n + audit))
        return min(ways)

    return inserted(0, 0)


def test_matrices_find_the_cheapest_least_audit():
    rng = random.Random(4)
    rows = [tuple((rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(1, 16))) for _ in range(1500)]
    lines = ["".join(chr(65 + 4 * r + f) for r, f in some) for some in rows]
    for some, matrix in zip(rows, dialogue.solve(lines)):
        assert dialogue.ending(matrix) == _cheapest(some)


def test_grammar_restores_its_sequences():
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 3, n) for n in (0, 1, 2, 3, 500, 900)] + [np.zeros(101, int)]
    short, rules = dialogue.re_pair(lines, 16)

    def spelt(symbol):
        return [symbol] if symbol < 16 else spelt(rules[symbol - 16][0]) + spelt(rules[symbol - 16][1])

    assert [[x for s in line for x in spelt(int(s))] for line in short] == [line.tolist() for line in lines]
    assert sum(map(len, short)) + 2 * len(rules) < sum(map(len, lines)) / 2


def test_ropes_compare_as_texts():
    rng = random.Random(5)
    made = [dialogue.Rope(c) for c in "DIKR"]
    for _ in range(400):
        made.append(rng.choice(made[-40:]) + rng.choice(made[-40:]) if rng.random() < 0.3 else rng.choice(made[:60]) + rng.choice(made[:60]))
    some = [r for r in made if r.size < 5000]
    for a, b in zip(rng.choices(some, k=2000), rng.choices(some, k=2000)):
        assert (a < b) == (str(a) < str(b))


TURNS = [
    (1, 1, "system", "Be kind."), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Hello."), (1, 5, "assistant", "Hello."),
    (2, None, "user", "No turn!"), (2, 1, "assistant", "cut off"), (2, 1, "tool", "x."), (3, 4, "user", " \t"), (4, 1, None, None),
    (None, 1, "user", "who?"), (None, 2, "assistant", "me."), (5, 1, "assistant", "First."), (5, 2, "assistant", "Second." * 3000),
    (6, 9, "user", "same."), (6, 9, "user", "same."), (6, 9, "user", "same."), (7, 1, "", ""), (8, 1, "assistant", "a."), (8, 2, "user", "b."),
]


def _by_hand(turns):
    """Every column of the repair of one conversation, row by row."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest())
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns), key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append(2 if not bare else 3 if (role, text) in seen else 1 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    codes = tuple(("sua".find(r[2][:1]) if r[2][:1] and r[2][:1] in "sua" else 3, f) for r, f in zip(rows, faults))
    cost, audit = _cheapest(codes)
    out, left, system = [], list(rows), False
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[2:]
        if edit == "D":
            continue
        if edit != "K":
            role = ("user", "assistant")[(len(out) - system) % 2]
        system = system or (not out and edit == "K" and role[:1] == "s")
        out.append(f"{role}:{text}")
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    firsts = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    counts = tuple(faults.count(k) for k in (2, 3, 1))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [1, 2, 512])
def test_conversations_repaired_as_by_hand(spark, block, monkeypatch):
    monkeypatch.setattr(dialogue, "FAN", 2)
    rng = random.Random(2)
    hot = [(9, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "ok!", f"{i}."])) for i in range(60)]
    turns = TURNS + hot
    df = spark.createDataFrame([(*r, "x") for r in turns], "conv_id bigint, turn bigint, role string, text string, symbol string")
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in dialogue.repair(df.repartition(4), block).collect()}
    for conv in {r[0] for r in turns}:
        assert got[conv] == _by_hand([r for r in turns if r[0] == conv]), conv
    assert len(got) == len({r[0] for r in turns})


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert dialogue.repair(none).collect() == []


def test_factor_and_rotation_equal_eigen_decomposition():
    rng = np.random.default_rng(8)
    for d, rank in ((1, 1), (2, 2), (7, 3), (40, 40)):
        a = rng.normal(size=(3 * d + 5, rank)) @ rng.normal(size=(rank, d))
        v = np.cov(a.T, bias=True).reshape(d, d)
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[np.ix_(order, order)]) and np.allclose(np.triu(factor, 1), 0)
        values, vectors = whitening.principal(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9)
        assert np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-12) and np.allclose(vectors @ v, values[:, None] * vectors)
    assert len(whitening.principal(np.zeros((3, 3)))[0]) == 0
    graded = np.diag([1e10, 1.0, 1e-2]) + 1e-3
    assert np.allclose(whitening.principal(graded)[0], [1e10, 1.0010, 0.011 - 1e-6], rtol=1e-4)


def test_whitened_rows_against_numpy(spark):
    rng = np.random.default_rng(6)
    base = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 40).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    vectors = base + [base[0]] * 200 + odd
    rows = [(i if i else None, v, 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x int").repartition(5)
    got = whitening.whitened(df, 4).collect()
    x = np.floor(64 * np.array(base)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * 500 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    for r in got:
        own = x[(r.vec_id or 0) if (r.vec_id or 0) < 300 else 0]
        assert int(r.deviation) == int(((n * own - sums) ** 2).sum())
        true = (own - sums / n) @ vectors[:, r.component - 1] / np.sqrt(values[r.component - 1])
        assert abs(r.whitened) == pytest.approx(abs(true), abs=1e-8)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    sign = {r.component: np.sign(r.whitened * ((x[1] - sums / n) @ vectors[:, r.component - 1])) for r in got if r.vec_id == 1}
    assert all(
        np.sign(r.whitened * ((x[2] - sums / n) @ vectors[:, r.component - 1])) == sign[r.component] for r in got if r.vec_id == 2
    )


def test_nothing_to_whiten(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 9.0])], schema)
    assert {r.component for r in whitening.whitened(huge).collect()} <= {1, 2}
