"""Quality rules against brute force."""
import collections
import math
import re

import pytest
import regex
import xxhash

from lakeshift.llm import quality, queries

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0d]+"


def brute_rules(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", s)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def brute_buckets(text, buckets):
    tokens = regex.findall(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+", text or "")

    def bucket(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p, h)
        return (h - (1 << 64) if h >> 63 else h) % buckets
    return [bucket(t) for t in tokens] + [bucket(a, b) for a, b in zip(["", *tokens], tokens)]


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        grams = brute_buckets(t, quality.BUCKETS)
        raw.update(grams)
        if i in good:
            target.update(grams)
    n_raw, n_target = raw.total() + quality.BUCKETS, target.total() + quality.BUCKETS
    for r in queries.op8_quality_rules(spark, SF).collect():
        text = dict(docs)[r.doc_id]
        want = brute_rules(text)
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == want
        grams = brute_buckets(text, quality.BUCKETS)
        llr = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in grams) / len(grams)
        assert r.llr == pytest.approx(llr, abs=1e-7)
        assert r.kept == (not want[5] and llr >= quality.THRESHOLD)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e a b c d e a b c d e"), (5, "one two three"),
         (5, "one two three"), (None, "x # | <> y\nx # | <> y\n\nx # | <> y"), (6, "w " * 20000),
         (7, "a b c d \x0be\x0cf")]


def test_rules_on_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, "r", "k") for i, t in EDGES], "doc_id long, text string, rules string, kept string")
    got = sorted((str(r.doc_id), tuple(r.rules)) for r in quality.rules(docs).collect())
    assert got == sorted((str(i), brute_rules(t)) for i, t in EDGES)


def test_assess_with_clashing_columns_and_without_target(spark):
    docs = spark.createDataFrame([(i, t, "r", 1.0) for i, t in EDGES], "doc_id long, text string, rules string, llr double")
    none = spark.createDataFrame([], "doc_id long")
    rows = quality.assess(docs, none).collect()
    assert len(rows) == len(EDGES) and all(r.llr == 0.0 for r in rows)
    assert all(r.kept == (not r.rules.base_failed) for r in rows)
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.assess(docs, docs.select("doc_id")).count() == 0
    assert quality.keep_good(docs, docs.select("doc_id")).count() == 0


def test_junk_scores_below_clean(spark):
    clean = [(i, f"The quick brown fox number {i} jumps over the lazy dog, and then it sleeps. " * 2) for i in range(40)]
    junk = [(100 + i, f"%%%{i} ### &&& *** ||| $$$ !!! ~~~ @@@ ^^^ {i} ### ||| &&&" * 2) for i in range(10)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    rows = quality.assess(docs, docs.filter("doc_id < 30").select("doc_id")).collect()
    assert min(r.llr for r in rows if r.doc_id < 100) > max(r.llr for r in rows if r.doc_id >= 100)


def test_many_trusted_ids_give_the_same_ratios(spark, monkeypatch):
    """The join by shuffle, for more ids than are sent to all tasks, counts the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    few = {tuple(r) for r in quality.fit(docs, good).collect()}
    monkeypatch.setattr(quality, "BROADCAST_IDS", 3)
    assert {tuple(r) for r in quality.fit(docs, good).collect()} == few and len(few) > 100
