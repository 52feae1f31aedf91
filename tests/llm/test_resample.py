"""Importance resampling against brute force; selection, ties and edge rows."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lakeshift.llm import queries, resample

SF = "/root/testdata/sf0.001"


def brute_features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, percent=10, min_words=20, size=10_000, longest=1, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % size

    corpus = collections.Counter(bucket(f) for _, t in docs for f in brute_features(t, longest)[0])
    wanted = collections.Counter(bucket(f) for t in target for f in brute_features(t, longest)[0])
    s, t = sum(corpus.values()), sum(wanted.values())
    out = []
    for doc_id, text in docs:
        found, words = brute_features(text, longest)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s + size) / ((corpus[b] + 1) * (t + size))))
                     for b in map(bucket, found))
        key = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, words, len(found), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op12_importance_resampling(spark, SF).collect()
    want = [(r[0], *r[2:]) for r in brute(docs, target)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcÉß9") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(n)]


def test_longer_features_ties_and_repeats(spark):
    docs = made(1, 300) + [(7, "a b c d e")] * 120 + [(None, "a b c d")] * 3 + [(8, None), (9, ""), (None, None)]
    target = [t for _, t in made(2, 40)] + [None, ""]
    frame = spark.createDataFrame([(i, t, -1) for i, t in docs], "doc_id long, text string, rank int")
    for percent in (10, 37, 100):
        got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent,
                                min_words=3, size=50, longest=3, seed=5)
        assert rows_of(got) == brute(docs, target, percent, 3, 50, 3, 5)


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in made(3, 50)], "doc_id string, text string")
    got = resample.resample(docs, docs, percent=50, min_words=1, size=100)
    ranks = [r["rank"] for r in got.collect() if r["rank"]]
    able = sum(brute_features(t)[1] >= 1 for _, t in made(3, 50))
    assert sorted(ranks) == list(range(1, able // 2 + 1))


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_key_by_quickselect(spark, k):
    rng = random.Random(k)
    rows = [(rng.randrange(4), i % 5 == 0, None if i % 5 == 0 else rng.randrange(9), 1, i) for i in range(1000)]
    keys = spark.createDataFrame(rows, "minus_score long, no_id boolean, id long, n_features long, row long")
    found = resample.kth_key(keys, k, len(rows), pivots=4, seed=k)
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0, r[3], r[4]))
    assert tuple(found) == order[k - 1]


def test_very_long_text_in_blocks():
    text = ("wort " * 700_000 + "x" * 3_000_000 + " ende").encode()
    parts = list(resample.feature_buckets(text, 1000, 2))
    whole = re.findall(rb"[0-9a-z]+", text)
    assert sum(n for n, _ in parts) == len(whole) and len(parts) > 3
    counts = sum(np.bincount(b, minlength=1000) for _, b in parts)
    want = collections.Counter(zlib.crc32(w) % 1000 for w in whole)
    want.update(zlib.crc32(a + b" " + b) % 1000 for a, b in zip(whole, whole[1:]))
    assert {i: int(n) for i, n in enumerate(counts) if n} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame(made(4, 30), "doc_id long, text string")
    assert resample.resample(docs, full).count() == 0
    assert rows_of(resample.resample(full, docs, percent=20, min_words=2)) == brute(made(4, 30), [], 20, 2)
