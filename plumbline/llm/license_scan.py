"""Licence scan: an exact set-similarity join of text blocks with licence templates, in DataFrame functions only.

A template is a set of words. A block is a line of a text, or the whole text for phrases. The join finds every block
that holds a template's share of words (containment threshold):

* words of templates are counted over all blocks and ordered from rare to frequent; other words cannot overlap;
* prefix filter: a block that meets the threshold holds one of a template's rarest words, so blocks are joined with
  templates on those words only;
* length filter: the block must hold as many template words as the overlap needs;
* positional filter: the matched word's place in both orders bounds the overlap that is still possible;
* what is left is counted exactly. Phrases are then confirmed word for word at their places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.materialize import materialize

#: Characters that are in no word once A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases whose words must stand together, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Licence sentences, labels, and the share of a sentence's words that a line must hold.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 0.8),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit", 0.8),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", 0.8),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 0.8),
    ("licensed under the gnu general public license version 3", "gpl-3", 1.0),
    ("licensed under the gnu general public license version 2", "gpl-2", 1.0),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 0.8),
    ("licensed under the gnu lesser general public license", "lgpl", 1.0),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 0.8),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa", 1.0),
    ("this work is licensed under a creative commons attribution license", "cc-by", 1.0),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.8),
)


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else re.escape(c) for c in word)


def _phrase(phrase: str) -> str:
    """Pattern of a phrase as whole consecutive words, A-Z in any case, leaving what follows unread."""
    return f"(?<!{WORD})" + f"{BREAK}+".join(_any_case(w) for w in phrase.split()) + f"(?!{WORD})"


def templates_of(phrases=PHRASES, sentences=TEMPLATES) -> list[tuple[str, str, bool, list[str], int]]:
    """template, label, whole (block is the whole text), words, need (words that must be held)."""
    rows = [(f"p{i}", label, True, sorted(set(text.split())), len(set(text.split()))) for i, (text, label) in enumerate(phrases)]
    for i, (text, label, share) in enumerate(sentences):
        words = sorted(set(text.split()))
        rows.append((f"s{i}", label, False, words, -int(-len(words) * share // 1)))
    return rows


def templates(spark: SparkSession, phrases=PHRASES, sentences=TEMPLATES) -> DataFrame:
    """One row per template."""
    return spark.createDataFrame(
        templates_of(phrases, sentences), "template string, label string, whole boolean, words array<string>, need int"
    )


def _vocabulary(phrases, sentences) -> list[str]:
    return sorted({w for text, *_ in (*phrases, *sentences) for w in text.split()})


def _known(text: Column, words: list[str]) -> Column:
    """Distinct template words of a text. Lower-casing turns one more character, the Kelvin sign, into an ASCII letter."""
    lowered = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    return F.array_intersect(F.split(lowered, f"{BREAK}+"), F.array(*[F.lit(w) for w in words]))


def scan(docs: DataFrame, phrases=PHRASES, sentences=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``docs`` needs doc_id and text; other columns are not read. A null text is empty: no words, labels empty, score 0.
    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are their smallest and largest start (null
    without any). ``score`` is the largest share of a template's words found in one block, 0 below the thresholds, 1 for
    a phrase. Rows that repeat doc_id and text get the same answer each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = _vocabulary(phrases, sentences)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Rows are told apart by doc_id and text; a struct also compares null ids as equal.
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("hash")).alias("row"), text.alias("text"))
    rows = rows.withColumn("held", _known(F.col("text"), vocabulary))

    # Global order: rare words first. One row per template word.
    words = rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r.word: r.n for r in words.collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ranked = lambda words: F.array_sort(F.transform(words, lambda w: rank[w]))
    rare = set()
    for _, _, _, held, need in templates_of(phrases, sentences):
        rare.update(sorted(held, key=order.get)[: len(held) - need + 1])

    # A text that holds no template's prefix word cannot match; the others keep their text for the blocks.
    may = F.arrays_overlap("held", F.array(*[F.lit(w) for w in sorted(rare)]))
    counted = rows.select(
        "row",
        F.regexp_count("text", F.lit(f"{WORD}+")).cast("bigint").alias("n_words"),
        F.when(may, F.col("text")).alias("text"),
        F.when(may, F.col("held")).alias("held"),
    )
    counted = materialize(counted, "license-texts")
    likely = counted.where("text is not null").select("row", "text", "held").distinct()
    lines = likely.select("row", F.explode(F.split("text", "\n")).alias("line")).select("row", _known(F.col("line"), vocabulary).alias("held"))
    blocks = likely.select("row", F.lit(True).alias("whole"), "held").unionByName(
        lines.select("row", F.lit(False).alias("whole"), "held").distinct()
    )

    known = templates(spark, phrases, sentences).withColumn("tokens", ranked(F.col("words"))).withColumn("n", F.size("tokens"))
    index = known.select("template", "label", "whole", "tokens", "n", "need", F.posexplode("tokens").alias("t_at", "token"))
    index = index.where(F.col("t_at") <= F.col("n") - F.col("need"))  # prefix of the template

    blocks = blocks.select("row", "whole", ranked(F.col("held")).alias("held")).withColumn("size", F.size("held"))
    probes = blocks.select("row", "whole", "held", "size", F.posexplode("held").alias("b_at", "token"))
    found = probes.join(F.broadcast(index), ["token", "whole"])  # the templates are a fixed list
    found = found.where(F.col("size") >= F.col("need"))  # length
    ahead = F.least(F.col("size") - F.col("b_at"), F.col("n") - F.col("t_at"))
    found = found.where(F.least("b_at", "t_at") + ahead >= F.col("need"))  # position
    found = found.withColumn("shared", F.size(F.array_intersect("held", "tokens"))).where("shared >= need")
    matches = found.groupBy("row").agg(
        F.collect_set(F.when(~F.col("whole"), F.col("label"))).alias("sentence_labels"),
        F.max(F.when(~F.col("whole"), F.col("shared") / F.col("n"))).alias("sentence_score"),
        F.max("whole").alias("may_hold"),
    )
    matches = materialize(matches, "license-matches")

    # Phrases: candidates of the join are confirmed word for word at their places.
    likely = likely.join(matches.where("may_hold").select("row"), "row", "left_semi")
    patterns = [(_phrase(p), label) for p, label in phrases]
    place_counts = [F.regexp_count("text", F.lit(f"(?={p})")) for p, _ in patterns]
    starts = []
    for pattern, _ in patterns:
        before_first = F.regexp_extract("text", f"(?s)^(.*?){pattern}", 1)
        before_last = F.regexp_extract("text", f"(?s)^(.*){pattern}", 1)
        starts.append([F.when(F.col("text").rlike(pattern), F.regexp_count(x, F.lit(f"{WORD}+"))) for x in (before_first, before_last)])
    labels_here = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(place_counts, patterns)]))
    placed = likely.select(
        "row",
        sum(place_counts[1:], place_counts[0]).cast("bigint").alias("n_base"),
        F.least(*[a for a, _ in starts], F.lit(None).cast("int")).cast("bigint").alias("first_word"),
        F.greatest(*[b for _, b in starts], F.lit(None).cast("int")).cast("bigint").alias("last_word"),
        labels_here.alias("phrase_labels"),
    ).where("n_base > 0").distinct()

    joined = counted.select("row", "n_words").join(matches.join(placed, "row", "left"), "row", "left")
    none = F.array().cast("array<string>")
    base = F.array_sort(F.array_distinct(F.coalesce("phrase_labels", none)))
    every = F.array_sort(F.array_union(F.coalesce("phrase_labels", none), F.coalesce("sentence_labels", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("sentence_score", F.lit(0.0)))
    return joined.select(
        "row.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same answer without filters or join order: every line against every template."""
    word = WORD
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    sentences = ", ".join(
        f"([{', '.join(repr(w) for w in sorted(set(t.split())))}], '{label}', {-int(-len(set(t.split())) * share // 1)})"
        for t, label, share in TEMPLATES
    )
    return rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), worded AS (
  SELECT doc_id, rid, text, regexp_extract_all(text, '{word}+') AS words FROM base
), phrases(phrase, label, k) AS (VALUES {phrases}), sentences(words, label, need) AS (VALUES {sentences}),
places AS (
  SELECT w.rid, p.label, i AS place
  FROM (SELECT * FROM worded WHERE regexp_matches(text, 'license|cc')) w, phrases p, range(0, len(w.words)) t(i)
  WHERE array_to_string(w.words[i + 1 : i + p.k], ' ') = p.phrase
), placed AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid
), lines AS (
  SELECT rid, list_distinct(regexp_extract_all(line, '{word}+')) AS words
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base)
), held AS (
  SELECT l.rid, s.label, len(list_intersect(l.words, s.words)) / len(s.words)::DOUBLE AS share
  FROM lines l, sentences s WHERE len(list_intersect(l.words, s.words)) >= s.need
), matched AS (
  SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM held GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(p.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END::DOUBLE AS score
FROM worded w LEFT JOIN placed p USING (rid) LEFT JOIN matched m USING (rid)
"""


SQL = _sql()
