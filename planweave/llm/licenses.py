"""License scans by diagonal voting: DataFrame functions only."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import let, written

#: Words are runs of what is no separator, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted: every word must stand there.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Notices that are recognised by most of their words.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words that say nothing about a license; two of them side by side don't vote.
COMMON = frozenset("a an and any are as at be by can form in is it may not of on or that the this to under use with you".split())
#: Least share of a notice's votes, and how far neighbouring diagonals and hits may lie apart.
LEAST_SHARE = 0.6
NEAR_DIAGONALS = 3
NEAR_WORDS = 8


def templates() -> list[tuple[int, str, bool, int, str, str, int]]:
    """(template, label, base, position, word, next word, votes): the word pairs of each template that vote."""
    out = []
    for t, (label, phrase) in enumerate(BASE + NOTICES):
        words = phrase.split()
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if t < len(BASE) or not {a, b} <= COMMON]
        out += [(t, label, t < len(BASE), i, a, b, len(pairs)) for i, a, b in pairs]
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pair_hash(word: str, after: str) -> int:
    """What Spark's xxhash64(word, after) gives."""
    hashed = xxhash.xxh64_intdigest(after.encode(), xxhash.xxh64_intdigest(word.encode(), 42))
    return hashed - (1 << 64) if hashed >> 63 else hashed


def word_pairs(text: Column) -> Column:
    """An array of (place, word, after, hash, n_words): a text's word pairs whose hash stands in the templates'
    hash set, and one entry at place -1 for the text itself."""
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")
    wanted = sorted({pair_hash(a, b) for *_, a, b, _ in templates()})

    def pairs(w: Column) -> Column:
        n = F.size(w).cast("long").alias("n_words")
        hashed = F.transform(w, lambda x, i: F.struct(i.cast("long").alias("place"), x.alias("word"), F.get(w, i + 1).alias("after"), F.xxhash64(x, F.get(w, i + 1)).alias("hash"), n))
        none = F.lit(None).cast("string")
        own = F.struct(F.lit(-1).cast("long").alias("place"), none.alias("word"), none.alias("after"), F.lit(None).cast("long").alias("hash"), n)
        return F.concat(F.array(own), F.filter(hashed, lambda p: p["hash"].isin(wanted)))

    return let(words, pairs)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every word pair of every whole text is hashed; the hashes are joined to the templates' word pairs, and the
    words themselves compared. A hit votes for its template's diagonal (place in the text less place in the
    template). A base phrase stands where a diagonal has all its votes. For notices, diagonals that follow each
    other by at most NEAR_DIAGONALS merge, and their hits are parted to spans where more than NEAR_WORDS words lie
    between two. A span is verified by the different places of the template whose words stand in it: a share of
    LEAST_SHARE or more gives the label. ``score`` is the largest share of
    a base phrase or a verified span, 0 if there is none. A null text is empty; null ids and repeated rows are
    rows like others; labels are empty strings where there is none; an empty table gives no rows; other columns
    are ignored. Texts are read once: their hits are written with a number of the row, so repeated rows stay
    apart, and no key grows with the input.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    grams = rows.select("row", "doc_id", F.explode(word_pairs(F.col("text"))).alias("g")).select("row", "doc_id", "g.*")
    listed = [(*t, pair_hash(t[4], t[5])) for t in templates()]
    table = docs.sparkSession.createDataFrame(listed, "template int, label string, base boolean, at int, w string, a string, votes int, h long")
    # broadcast: as large as the constants above
    met = grams.join(F.broadcast(table), (F.col("hash") == F.col("h")) & (F.col("word") == F.col("w")) & (F.col("after") == F.col("a")), "left")
    met = written(met.filter("place = -1 OR template IS NOT NULL").select("row", F.when(F.col("place") == -1, F.col("doc_id")).alias("doc_id"), F.when(F.col("place") == -1, F.col("n_words")).alias("n_words"), "place", "template", "label", "base", "at", "votes"))
    key = ["row", "template", "label", "base", "votes"]
    hits = met.filter("place >= 0").select(*key, "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))
    base = hits.filter("base").groupBy(*key, F.col("diagonal").alias("start")).agg(F.count("*").alias("n")).filter("n = votes").select(*key, "start", F.lit(1.0).alias("share"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal", "place")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR_DIAGONALS).cast("int"), F.lit(0))
    chained = hits.filter("NOT base").withColumn("far", far).withColumn("chain", F.sum("far").over(by_diagonal))
    by_place = Window.partitionBy("row", "template", "chain").orderBy("place", "diagonal")
    apart = F.coalesce((F.col("place") - F.lag("place").over(by_place) > NEAR_WORDS).cast("int"), F.lit(0))
    spans = chained.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by_place)).groupBy(*key, "chain", "span")
    spans = spans.agg(F.count_distinct("at").alias("n"), F.min("place").alias("start")).withColumn("share", F.col("n") / F.col("votes"))
    found = base.unionByName(spans.filter(F.col("share") >= LEAST_SHARE).select(*key, "start", "share")).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    joined = met.filter("place = -1").select("row", "doc_id", "n_words").join(found, "row", "left")
    none = F.lit("")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def duckdb_sql() -> str:
    """The same rows by DuckDB, without hashes."""
    values = ", ".join(f"({t}, '{label}', {base}, {at}, '{a} {b}', {votes})" for t, label, base, at, a, b, votes in templates())
    return f"""
        WITH t(template, label, base, spot, pair, votes) AS (VALUES {values}),
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(words))) AS i, words FROM w),
        h AS (SELECT doc_id, template, label, base, votes, spot, i - 1 AS place, i - 1 - spot AS diagonal
              FROM (SELECT doc_id, i, words[i] || ' ' || words[i + 1] AS gram FROM g) JOIN t ON gram = pair),
        d AS (SELECT doc_id, label, diagonal AS start FROM h WHERE base GROUP BY doc_id, template, label, votes, diagonal HAVING count(*) = votes),
        s AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place) > {NEAR_DIAGONALS}, false)::int AS far FROM h WHERE NOT base),
        c AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS chain FROM s),
        q AS (SELECT *, coalesce(place - lag(place) OVER (PARTITION BY doc_id, template, chain ORDER BY place, diagonal) > {NEAR_WORDS}, false)::int AS apart FROM c),
        p AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template, chain ORDER BY place, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM q),
        f AS (SELECT doc_id, label, true AS base, start, 1.0::double AS share FROM d UNION ALL
              SELECT doc_id, label, false, min(place), count(DISTINCT spot)::double / votes FROM p GROUP BY doc_id, template, label, votes, chain, span
              HAVING count(DISTINCT spot)::double / votes >= {LEAST_SHARE}),
        r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
              FROM f GROUP BY doc_id)
        SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
          coalesce(labels, '') AS labels, coalesce(score, 0.0::double) AS score
        FROM w LEFT JOIN r ON w.doc_id = r.doc_id"""
