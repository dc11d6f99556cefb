import random
import re

from planweave.llm.licenses import BASE, COMMON, LEAST_SHARE, NEAR_DIAGONALS, NEAR_WORDS, NOTICES, scan_licenses

ROWS = [
    (1, "CC-BY and cc by, CC/BY; All rights reserved. all\nRIGHTS--reserved"),
    (2, None),
    (3, ""),
    (4, "the GNU General Public  License v3"),
    (5, "x " * 60_000 + "All Rights Reserved"),
    (6, "Released under MIT license"),
    (7, "Licensed under the Apache License, Version 2.0."),
    (8, "all rights were reserved; accby cc bye général public license"),
    (8, "all rights were reserved; accby cc bye général public license"),
    (None, "All rights reserved."),
    (9, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that following conditions are met:"),
    (10, "...general public license"),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases(docs):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(docs(ROWS)).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in ROWS), key=repr)


def test_notices(docs):
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs(ROWS)).collect()}
    assert got[7] == ("apache", 1.0)
    assert got[9][0] == "bsd" and 0.6 <= got[9][1] < 1
    assert got[8] == ("", 0.0)
    assert got[1] == ("cc-by,reserved", 1.0)


def notice_labels(text):
    """The labels of notices, by walking over each notice's hits: which places of the notice stand near each other."""
    words, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), {}
    for label, notice in NOTICES:
        n = notice.split()
        own = [i for i in range(len(n) - 1) if not {n[i], n[i + 1]} <= COMMON]
        hits = sorted((p - i, p, i) for i in own for p in range(len(words) - 1) if words[p : p + 2] == n[i : i + 2])
        chains = [[]]
        for k, hit in enumerate(hits):
            if k and hit[0] - hits[k - 1][0] > NEAR_DIAGONALS:
                chains.append([])
            chains[-1].append(hit)
        for chain in chains:
            places, before = set(), None
            for _, p, i in sorted(chain, key=lambda h: (h[1], h[0])):
                if before is not None and p - before > NEAR_WORDS:
                    places = set()
                places.add(i)
                before = p
                share = len(places) / len(own)
                if share >= LEAST_SHARE:
                    labels[label] = max(labels.get(label, 0), share)
    return labels


def test_notices_by_walking(docs):
    rng, rows = random.Random(2), []
    for i in range(120):
        words = rng.choice(NOTICES)[1].split()
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice(([], ["added"], ["x", "y", "z"], ["the", "license"], ["mit", "license"]))
        rows.append((i, "own words before " * rng.randrange(3) + " ".join(words) + " and after " * rng.randrange(2)))
    rows += [(200, "mit license mit license"), (201, "apache license " * 4), (202, "released under the mit license " * 3)]
    rows.append((203, "you may not use this file except in compliance with the license version 2 0 you may obtain a copy of the license at"))
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in scan_licenses(docs(rows)).collect()}
    for i, text in rows:
        labels = notice_labels(text)
        assert set(filter(None, got[i][0].split(","))) == set(labels) | set(filter(None, got[i][1].split(",")))
        assert got[i][1] or abs(got[i][2] - max(labels.values(), default=0.0)) < 1e-9
    assert got[200] == got[201] == ("", "", 0.0)
    assert got[202] == ("mit", "", 1.0) and got[203][0] == "apache"


def test_only_ascii_is_lowered(docs):
    got = scan_licenses(docs([(1, "ALL RIGHTS RESERVED"), (2, "ALL R\u0130GHTS RESERVED")])).collect()
    assert {r.doc_id: r.n_base for r in got} == {1: 1, 2: 0}


def test_empty_and_clashing(spark, docs):
    assert scan_licenses(docs([])).count() == 0
    df = spark.createDataFrame([(1, "cc by", 2, "p", 3, "w", 4)], "doc_id long, text string, place int, pair string, template int, words string, row int")
    assert [r.n_base for r in scan_licenses(df).collect()] == [1]


def test_sql(against_duckdb):
    against_duckdb("op1_license_scan")
    against_duckdb("op1_license_scan", "/root/testdata/sf0.01")
