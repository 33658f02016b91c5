"""Repair of conversation structure by dynamic programming over a grammar of role and fault sequences.

A conversation is a sequence of symbols (role class, fault). Each symbol has a min-plus transfer matrix over four
states: nothing yet, after a system turn, after a user turn, after an assistant turn. An entry is the least cost of the
row's edit, with the insertions before it, and the edits' initials. Sequences of a batch are compressed together by
Re-Pair: the commonest pair of symbols becomes a rule until none repeats. A rule's matrix is the product of its two
sides', computed once and shared by all conversations that hold it; its audit is a rope of its sides' audits. Long
conversations are cut into blocks, whose matrices are multiplied in a tree over tasks.

Every audit of a run of rows ends with a row's edit and holds as many row edits as there are rows, so none is a proper
prefix of another. Of two audits of one cost the ASCII-least stays so whatever follows, and products may keep one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.materialize import materialize
from plumbline.plans.ordered import POSITION, ordered

#: Rows a block, blocks multiplied by one task at a time, and symbols compressed into one grammar.
BLOCK, FAN, GRAMMAR_SYMBOLS = 512, 64, 200_000
#: A pair must be there so often to become a rule.
LEAST_PAIR = 2
#: Repeated rows are spread in runs of this many.
RUN = 4096

#: Costs of edits and of an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES, STOPS = " \t\n\x0b\f\r", (".", "!", "?")

START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles by initial, in the order of their codes; any other initial is the last code.
INITIALS = "sua"
#: Faults in the order of their codes.
FAULTS = ("", "truncated", "blank", "duplicate")
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_STATES = range(4)

_MODULUS, _BASE = (1 << 127) - 1, 1_000_003


class Rope:
    """A text as a leaf or as two ropes, with length and hash, so that shared parts are stored and compared once."""

    __slots__ = ("left", "right", "text", "size", "hash")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size, value = len(text), 0
            for letter in text:
                value = (value * _BASE + ord(letter)) % _MODULUS
            self.hash = value
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_BASE, right.size, _MODULUS) + right.hash) % _MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        if self.size + other.size <= 16:
            return Rope(str(self) + str(other))
        return Rope("", self, other)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                out.append(rope.text)
            else:
                stack += (rope.right, rope.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        mine, others = [self], [other]
        while mine and others:
            a, b = mine.pop(), others.pop()
            if a.size == b.size and a.hash == b.hash:
                continue
            if a.left is None and b.left is None:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.size > n:
                    mine.append(Rope(a.text[n:]))
                if b.size > n:
                    others.append(Rope(b.text[n:]))
            elif b.left is None or (a.left is not None and a.size >= b.size):
                mine += (a.right, a.left)
                others.append(b)
            else:
                others += (b.right, b.left)
                mine.append(a)
        return bool(others)


_NONE = Rope()
#: Least insertions between states: their number is the cost over INSERT and the length of the audit.
_INSERTED = {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1,
             (ASSISTANT, USER): 1} | {(s, s): 0 for s in _STATES}

Matrix = list  # 16 entries, None or (cost, Rope), row by row


def _less(a, b):
    return a is not None and (b is None or a[0] < b[0] or (a[0] == b[0] and a[1] is not b[1] and a[1] < b[1]))


def transfer(role: int, fault: int) -> Matrix:
    """Matrix of one row: insertions, then its edit."""
    edits = [(s, s, DELETE, "D") for s in _STATES]
    if fault < 2:
        extra = TRUNCATED if fault == 1 else 0
        kept = {0: [(START, SYSTEM)], 1: [(s, USER) for s in (START, SYSTEM, ASSISTANT)], 2: [(USER, ASSISTANT)]}.get(role, [])
        turned = [(START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]
        edits += [(a, b, extra, "K") for a, b in kept] + [(a, b, REROLE + extra, "R") for a, b in turned]
    out: Matrix = [None] * 16
    for (start, middle), n in _INSERTED.items():
        for a, b, cost, letter in edits:
            if a == middle:
                found = (cost + INSERT * n, Rope("I" * n + letter))
                if _less(found, out[4 * start + b]):
                    out[4 * start + b] = found
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest way through both, the ASCII-least audit of equally cheap ones."""
    out: Matrix = [None] * 16
    for i in _STATES:
        for k in _STATES:
            x = a[4 * i + k]
            if x is None:
                continue
            for j in _STATES:
                y = b[4 * k + j]
                if y is not None:
                    best, cost = out[4 * i + j], x[0] + y[0]
                    if best is None or cost <= best[0]:
                        found = (cost, x[1] + y[1])
                        if _less(found, best):
                            out[4 * i + j] = found
    return out


def ending(matrix: Matrix | None) -> tuple[int, str]:
    """Cheapest repair of a whole conversation; none for one without rows."""
    best = None
    for state in _STATES:
        entry = (0, _NONE) if matrix is None and state == START else matrix[state] if matrix else None
        if entry is not None:
            for end in (START, ASSISTANT):
                n = _INSERTED.get((state, end))
                if n is not None:
                    found = (entry[0] + INSERT * n, entry[1] + Rope("I" * n))
                    best = found if _less(found, best) else best
    return best[0], str(best[1])


def re_pair(sequences: list[np.ndarray], first_rule: int, least: int = LEAST_PAIR) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Sequences with repeated pairs replaced by rules, and the rules; rule k is symbol ``first_rule + k``.

    The commonest pair goes first, the smaller one of equally common ones. Pairs do not reach over sequences.
    """
    ends = np.cumsum([len(s) + 1 for s in sequences])
    line = np.full(ends[-1] if len(ends) else 0, -1, dtype=np.int64)
    for s, end in zip(sequences, ends):
        line[end - 1 - len(s) : end - 1] = s
    rules: list[tuple[int, int]] = []
    while len(line) > 2:
        a, b = line[:-1], line[1:]
        inside = (a >= 0) & (b >= 0)
        codes = a * (first_rule + len(rules) + 1) + b
        if not inside.any():
            break
        found, counts = np.unique(codes[inside], return_counts=True)
        top = counts.argmax()
        if counts[top] < least:
            break
        x, y = divmod(int(found[top]), first_rule + len(rules) + 1)
        at = np.flatnonzero(inside & (codes == found[top]))
        if x == y:  # in a run of one symbol every other pair is free
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
            at = at[(at - at[np.r_[True, np.diff(at) > 1]][run]) % 2 == 0]
            if len(at) < least:  # a run of three holds two pairs and room for one: nothing is saved
                break
        line[at] = first_rule + len(rules)
        line = np.delete(line, at + 1)
        rules.append((x, y))
    cuts = np.flatnonzero(line < 0)
    return [line[a:b] for a, b in zip(np.r_[0, cuts[:-1] + 1], cuts)] if len(cuts) else [], rules


_TERMINALS = 4 * (len(INITIALS) + 1)


def solve(sequences: list[str]) -> list[Matrix]:
    """Matrix of every sequence of symbol letters, through one grammar for all of them."""
    distinct = {s: k for k, s in enumerate(dict.fromkeys(sequences))}
    codes = [np.frombuffer(s.encode(), dtype=np.uint8).astype(np.int64) - ord("A") for s in distinct]
    short, rules = re_pair(codes, _TERMINALS)
    matrices = [transfer(*divmod(k, 4)) for k in range(_TERMINALS)]
    for left, right in rules:  # bottom-up: sides are older than their rule
        matrices.append(product(matrices[left], matrices[right]))
    whole = []
    for line in short:
        total = matrices[line[0]]
        for symbol in line[1:]:
            total = product(total, matrices[symbol])
        whole.append(total)
    return [whole[distinct[s]] for s in sequences]


def _illegal(sequence: str) -> int:
    roles = [(ord(c) - ord("A")) // 4 for c in sequence]
    return sum(pair not in _LEGAL for pair in zip(roles[:-1], roles[1:]))


_BLOCKS = "{key}, block bigint, first int, last int, illegal bigint, costs array<int>, audits array<string>"


def _packed(matrix: Matrix) -> tuple[list, list]:
    return [None if e is None else e[0] for e in matrix], [None if e is None else str(e[1]) for e in matrix]


def _unpacked(costs, audits) -> Matrix:
    return [None if a is None else (int(c), Rope(a)) for c, a in zip(costs, audits)]


def _solver(single: bool):
    """Blocks with their matrices, or whole conversations with cost and audit; one grammar for a bounded run of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(2).to_pylist()
            start = 0
            while start < len(lines):
                stop, held = start, 0
                while stop < len(lines) and (stop == start or held + len(lines[stop]) <= GRAMMAR_SYMBOLS):
                    held += len(lines[stop])
                    stop += 1
                own = lines[start:stop]
                matrices = solve(own)
                given = batch.slice(start, stop - start)
                if single:
                    ends = [ending(m) for m in matrices]
                    columns = [given.column(0), pa.array(map(_illegal, own), pa.int64())]
                    columns += [pa.array([c for c, _ in ends], pa.int64()), pa.array([a for _, a in ends], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "illegal", "cost", "audit"])
                else:
                    packed = [_packed(m) for m in matrices]
                    role = lambda c: (ord(c) - ord("A")) // 4
                    columns = [given.column(0), given.column(1), pa.array([role(s[0]) for s in own], pa.int32())]
                    columns += [pa.array([role(s[-1]) for s in own], pa.int32()), pa.array(map(_illegal, own), pa.int64())]
                    columns += [pa.array([c for c, _ in packed], pa.list_(pa.int32())), pa.array([a for _, a in packed], pa.list_(pa.string()))]
                    names = ["conv_id", "block", "first", "last", "illegal", "costs", "audits"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                start = stop

    return run


def _joined(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("block")
    matrix, illegal, last = None, 0, None
    for r in part.itertuples():
        own = _unpacked(r.costs, r.audits)
        matrix = own if matrix is None else product(matrix, own)
        illegal += r.illegal + (last is not None and (last, r.first) not in _LEGAL)
        last = r.last
    costs, audits = _packed(matrix)
    ends = {"block": [part["block"].iloc[0] // FAN], "first": [part["first"].iloc[0]], "last": [last], "illegal": [illegal]}
    return pd.DataFrame({"conv_id": part["conv_id"].iloc[:1].to_numpy(), **ends, "costs": [costs], "audits": [audits]})


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [ending(_unpacked(c, a)) for c, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        columns = [batch.column(0), batch.column(1), pa.array([c for c, _ in ends], pa.int64()), pa.array([a for _, a in ends], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "illegal", "cost", "audit"])


def _filled(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))


_ORDER = ("turn", "role", "digest")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy, fault and symbol of every row; texts stay behind.

    ``fault`` is the first of blank, duplicate, truncated, or empty. Rows of a turn are ordered by role and a digest of
    role and text. Equal rows are folded before any shuffle, and repeats are found from the first turn of each text, so
    neither a hot conversation nor a hot text meets in one task.
    """
    stripped = F.rtrim("text", F.lit(SPACES))
    rows = _filled(turns).select(
        "conv_id", "turn", "role", "digest", (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(*STOPS)).alias("cut"),
    )
    folded = materialize(rows.groupBy("conv_id", *_ORDER, "blank", "cut").agg(F.count(F.lit(1)).alias("copies")), "turns")
    repeated = folded.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("early"), F.sum("copies").alias("n")).where("n > 1")
    repeated = repeated.select(F.col("conv_id").alias("__c"), F.col("digest").alias("__d"), "early")
    met = folded.join(repeated, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("digest") == F.col("__d")), "left")
    later = F.col("early").isNotNull() & ~F.col("turn").eqNullSafe(F.col("early.turn"))
    runs = met.select("conv_id", *_ORDER, "blank", "cut", later.alias("later"), "copies",
                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))).alias("base"))
    last = F.least(F.col("base") + RUN, F.col("copies")) - 1
    each = runs.withColumn("copy", F.explode(F.sequence("base", last)))
    fault = F.when(F.col("blank"), 2).when(F.col("later") | (F.col("copy") > 0), 3).when(F.col("cut"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.lit(len(INITIALS))
    for code, letter in enumerate(INITIALS):
        role = F.when(initial == letter, code).otherwise(role)
    symbol = F.chr((ord("A") + role * 4 + fault).cast("long"))
    names = F.element_at(F.array(*map(F.lit, FAULTS)), fault + 1)
    return each.select("conv_id", *_ORDER, "copy", names.alias("fault"), symbol.alias("symbol"))


def diagnose(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    marked = materialize(faults(turns), "symbols")
    is_fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    facts = marked.groupBy("conv_id").agg(
        F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"), *[is_fault(f) for f in ("blank", "duplicate", "truncated")]
    )
    placed = ordered(marked, [*_ORDER, "copy"], ["conv_id"])
    cells = F.sort_array(F.collect_list(F.struct(POSITION, "symbol")))  # at most ``block`` rows
    own = F.floor(F.col(POSITION) / block).cast("long").alias("block")
    lines = placed.df.groupBy("conv_id", own).agg(F.array_join(F.transform(cells, lambda c: c["symbol"]), "").alias("line"))
    key = marked.schema["conv_id"].dataType.simpleString()
    whole = f"conv_id {key}, illegal bigint, cost bigint, audit string"
    top = (placed.largest - 1) // block
    if top <= 0:
        solved = lines.mapInArrow(_solver(True), whole)
    else:
        schema = _BLOCKS.format(key=f"conv_id {key}")
        parts = lines.mapInArrow(_solver(False), schema)
        while top > 0:  # a tree: each step leaves one row where there were up to FAN
            parts = parts.groupBy("conv_id", F.floor(F.col("block") / FAN)).applyInPandas(_joined, schema)
            top //= FAN
        solved = parts.select("conv_id", "illegal", "costs", "audits").mapInArrow(_ended, whole)
    solved = solved.withColumnRenamed("conv_id", "__c")
    return facts.join(solved, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")


def _editor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation, led by its audit, as repaired rows."""
    audit, at, place, system = "", 0, 0, False

    def inserted(out, conv):
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            out.append((conv, place, _turn(place, system), "", "insert"))
            at, place = at + 1, place + 1

    conv = None
    for batch in batches:
        out = []
        for given, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if kind == 0:
                inserted(out, conv)
                conv, audit, at, place, system = given, text, 0, 0, False
                continue
            inserted(out, conv)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K":
                system = system or (place == 0 and role[:1] == "s")
                out.append((conv, place, role, text, "keep"))
            else:
                out.append((conv, place, _turn(place, system), text, "rerole"))
            place += 1
        yield _repaired(batch, out)
    out = []
    inserted(out, conv)
    if out:
        yield _repaired(batch, out)


def _turn(place: int, system: bool) -> str:
    return "user" if (place - system) % 2 == 0 else "assistant"


def _repaired(batch: pa.RecordBatch, out: list) -> pa.RecordBatch:
    types = (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
    columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text", "edit"])


def apply_edits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired rows, in order inside each partition and conversations whole: conv_id, place, role, text, edit.

    ``found`` has conv_id and audit, as ``diagnose`` gives them. Rows stream behind their audit, so memory holds one
    audit and one batch, however long a conversation is.
    """
    rows = _filled(turns).withColumn("kind", F.lit(1))
    lead = found.select(
        "conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"),
    )
    both = lead.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    key = turns.schema["conv_id"].dataType.simpleString()
    stream = both.select("conv_id", "kind", "role", "text")
    return stream.mapInArrow(_editor, f"conv_id {key}, place bigint, role string, text string, edit string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest = None, None
    for batch in batches:
        out = []
        for given, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if place == 0:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = given, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in out], batch.column(0).type), pa.array([d for _, d in out], pa.string())],
            names=["conv_id", "repaired_sha256"],
        )
    if digest is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], batch.column(0).type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"]
        )


_EMPTY_SHA = hashlib.sha256().hexdigest()


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` needs conv_id, turn, role and text; other columns are not read. Null roles and texts are one space. Null
    conv_ids are one conversation. Null turns come first and count for no gap; rows of one turn are ordered by role and
    a digest of their text, equal rows being duplicates. An empty table gives no rows.
    """
    found = materialize(diagnose(turns, block), "audits")
    key = turns.schema["conv_id"].dataType.simpleString()
    digests = apply_edits(turns, found).select("conv_id", "place", "role", "text").mapInArrow(
        _hashed, f"conv_id {key}, repaired_sha256 string"
    )
    digests = digests.withColumnRenamed("conv_id", "__c")
    joined = found.join(digests, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)))


def damage(turns: DataFrame) -> DataFrame:
    """The test damage of the query: rows dropped, emptied, cut, repeated or given to the user by a checksum of their key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their repair; every original conv_id has a row."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed = repair(damage(turns)).withColumnRenamed("conv_id", "__c")
    every = turns.select("conv_id").distinct()
    joined = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256")
    )


_SPACE = r"[\x20\x09-\x0D]"
#: The same answer by forward search, one row of a conversation at a time, without grammar or matrices.
SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: ord(c)::UBIGINT), lambda acc, b: list_reduce(range(8)::UBIGINT[],
        lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1)), xor(acc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text)) AS p,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, p, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
    count_if(fault = 'truncated')::BIGINT AS truncated,
    count_if(p > 1 AND coalesce(before, '') || r NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM judged GROUP BY conv_id
), inserts(f, m, n) AS (
  VALUES ('0', '0', 0), ('0', 'u', 1), ('0', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2), ('u', 'u', 0), ('u', 'a', 1),
    ('a', 'a', 0), ('a', 'u', 1)
), edits(m, t, edit) AS (
  VALUES ('0', 's', 'K'), ('0', 'u', 'K'), ('s', 'u', 'K'), ('a', 'u', 'K'), ('u', 'a', 'K'), ('0', 'u', 'R'), ('s', 'u', 'R'),
    ('a', 'u', 'R'), ('u', 'a', 'R'), ('0', '0', 'D'), ('s', 's', 'D'), ('u', 'u', 'D'), ('a', 'a', 'D')
), moves AS (
  SELECT f, t, edit, {INSERT} * n + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN {REROLE} ELSE {DELETE} END AS c, repeat('I', n) || edit AS a
  FROM inserts JOIN edits USING (m)
), ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS p, '0' AS state, {{'c': 0::BIGINT, 'a': ''}} AS way FROM judged
  UNION ALL
  SELECT w.conv_id, w.p + 1, m.t,
    min({{'c': (w.way.c + m.c + CASE WHEN j.fault = 'truncated' AND edit <> 'D' THEN {TRUNCATED} ELSE 0 END)::BIGINT, 'a': w.way.a || m.a}})
  FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.p = w.p + 1 JOIN moves m ON m.f = w.state
  WHERE edit = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR m.t = j.r))
  GROUP BY w.conv_id, w.p, m.t
), best AS (
  SELECT w.conv_id, min({{'c': (w.way.c + {INSERT} * n)::BIGINT, 'a': w.way.a || repeat('I', n)}}) AS way
  FROM ways w JOIN (SELECT conv_id, max(p) AS last FROM judged GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.last = w.p
  JOIN inserts ON f = w.state AND m IN ('0', 'a') GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, i, way.a[i] AS edit, count(*) FILTER (way.a[i] <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS p,
    count(*) FILTER (way.a[i] <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS place
  FROM (SELECT conv_id, way, unnest(range(1, len(way.a) + 1)) AS i FROM best)
), kept AS (
  SELECT l.*, j.role, j.text, coalesce(max(CASE WHEN place = 1 AND edit = 'K' AND r = 's' THEN 1 END) OVER (PARTITION BY l.conv_id), 0) AS system
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.p = l.p AND l.edit <> 'I' WHERE l.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS text FROM kept GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.way.c, 0)::BIGINT AS cost,
  coalesce(b.way.a, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
