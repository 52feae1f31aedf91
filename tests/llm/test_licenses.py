"""License scan against brute force."""
import itertools
import re
from re import _constants as code
from re import _parser as parser

from lakeshift.llm import licenses, queries

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = licenses.signature_rules()


def brute(text):
    words = re.findall(licenses.WORD, (text or "").translate(LOWER))
    norm = " " + " ".join(words) + " "
    found = []
    for rule in RULES:
        for m in re.finditer(rule.pattern, norm):
            first = norm[:m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" "), rule))

    def rank(d):
        return d[2].priority, d[0] - d[1], d[2].rule_id
    kept = [a for a in found if not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and rank(b) < rank(a) for b in found)]
    base = [d for d in found if d[2].priority == 4]
    starts = [d[0] for d in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({d[2].label for d in base})), ",".join(sorted({d[2].label for d in base + kept})),
            max([d[2].confidence for d in kept], default=0.0), len(kept))


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_detections)


TEXTS = ["", None, "Licensed under CC BY-NC 4.0.", "mit license mit license MIT  License", "the GNU General Public License, version 3",
         "SPDX-License-Identifier: Apache-2.0 and Apache License, Version 2.0", "submit licenses", "commit mit-license;apache\nlicense",
         "CC\tBY cc by-sa 4.0 CC-BY-ND", "Permission is hereby granted, free of charge, to any person obtaining a copy",
         "All rights reserved. Released into the public domain under the Unlicense", "é gnu general public licenceé gnu general public license",
         "gnu general public license " * 300]


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 300 and len({r.rule_id for r in RULES}) == len(RULES)


def test_texts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.id: row(r) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_every_rule_passes_its_gate(spark):
    """The prefilter never loses a detection: a sample text of each family goes through."""
    names = ["GPL v3", "LGPL 2.1", "AGPL 3", "BSD 3-Clause", "0BSD", "CDDL 1.0", "MPL 2.0", "EUPL 1.2", "WTFPL", "CC0 1.0",
             "Creative Commons Attribution-ShareAlike 4.0", "Mulan PSL v2", "zlib/libpng license", "BSL 1.0", "GFDL 1.3",
             "commons clause", "proprietary and confidential", "redistribution and use in source and binary forms"]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    got = {r.id: row(r) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(names)} and all(r[5] for r in got.values())


def test_repeated_and_null_ids(spark):
    text = "mit license"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "apache license")], "doc_id long, text string")
    got = sorted((str(r.id), *row(r)) for r in licenses.scan(docs).collect())
    assert got == sorted((i, *brute(t)) for i, t in (("1", text), ("1", text), ("None", text), ("None", "apache license")))


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: row(r) for r in queries.op2_license_scan(spark, SF).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def spellings(pattern):
    """Every text that ``pattern`` matches (literals, sets, alternatives and optional parts)."""
    def of(nodes):
        return {"".join(p) for p in itertools.product(*[one(*n) for n in nodes])}

    def one(op, value):
        if op == code.LITERAL:
            return {chr(value)}
        if op == code.IN:
            return {chr(c) for _, c in value}
        if op == code.BRANCH:
            return set().union(*map(of, value[1]))
        if op == code.SUBPATTERN:
            return of(value[3])
        if op == code.MAX_REPEAT:
            assert value[:2] == (0, 1)
            return {""} | of(value[2])
        assert op in (code.ASSERT, code.ASSERT_NOT)
        return {""}
    return of(parser.parse(pattern))


def test_every_spelling_holds_its_keyword_and_an_anchor():
    anchors = licenses.anchors(RULES)
    for rule in RULES:
        for text in spellings(rule.pattern):
            assert rule.keyword in text, (rule, text)
            assert any(a in text for a in anchors) or "cc by" in text, (rule, text)


def test_every_spelling_of_a_name_matches_brute_force(spark):
    texts = sorted({t for _, _, name, _ in licenses.FAMILIES for t in spellings(name)} | {
        "Released under the Expat License", "available under X11 licence", "BSL v1.0", "licensed under the BSL"})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: row(r) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} and all(r[5] for r in got.values())


def test_many_matches_take_linear_time(spark):
    """Four times the matches in one row: not much more than four times the time."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "mit license and more " * n)], "doc_id long, text string")
        start = time.perf_counter()
        row = licenses.scan(docs).first()
        took = time.perf_counter() - start
        assert row.n_base == n and row.first_word == 0 and row.last_word == 4 * (n - 1)
        return took
    seconds(1000)
    few = min(seconds(40_000), seconds(40_000))
    assert seconds(160_000) <= 6 * max(few, 1.0)


def test_places_of_matches(spark):
    text = "MIT License, mit license; the cc by x GNU General Public License mit  license"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "mit"), (3, None)], "doc_id long, text string")
    found = licenses.detections(docs)
    base = sorted((r.id, r.label, r.first, r.last) for r in found.filter("priority = 4").collect())
    assert base == [(1, "cc-by", 5, 6), (1, "gpl", 8, 11), (1, "mit", 0, 1), (1, "mit", 2, 3), (1, "mit", 12, 13)]
