"""Benchmark decontamination against brute force."""
import collections
import random

import numpy as np
import pytest

from lakeshift.llm import decontaminate as dc
from lakeshift.llm import queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    """Word shingles by the rules of the operator, as tuples: nothing of its hashing."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in low).split(" ")
    words = [w for w in words if w]
    return [tuple(words[k:k + 5]) for k in range(len(words) - 4)]


def brute(docs, items, threshold=0.8):
    """Best weighted Jaccard of each item over every alignment of every document."""
    found = {}
    bags = [(i, collections.Counter(shingles(t))) for i, t in items]
    for d, text in docs:
        own = shingles(text)
        for i, bag in bags:
            n = bag.total()
            if not n or not set(bag) & set(own):
                continue
            best = 0.0
            for at in range(max(1, len(own) - n + 1)):
                window = collections.Counter(own[at:at + n])
                best = max(best, (window & bag).total() / (window | bag).total())
            if best >= threshold and best > found.get((d, i), 0.0):
                found[d, i] = best
    return found


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op3_decontamination(spark, SF).collect()}
    want = brute(docs, items)
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_planted_items_anywhere_and_edited(spark):
    rng = random.Random(1)
    items = [(i, words(rng, n)) for i, n in enumerate([6, 9, 14, 20, 33, 47, 60, 90, 300, 700])]
    docs, planted = [], set()
    for d in range(120):
        body = words(rng, rng.randrange(0, 400))
        i, item = items[d % len(items)]
        if d % 3:
            part = list(item)
            if d % 3 == 2 and len(part) >= 60:
                part[len(part) // 2] = "changed"
            at = rng.choice([0, len(body), rng.randrange(len(body) + 1)])
            body[at:at] = part
            planted.add((d, i))
        docs.append((d, " ".join(body).upper() if d % 2 else ", ".join(body)))
    texts = [(i, " ".join(t)) for i, t in items]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, similarity int")
    bench = spark.createDataFrame(texts, "item_id long, text string")
    rows = dc.matches(frame, bench).collect()
    assert {(r.id, r.item_id) for r in rows} == planted == set(brute(docs, texts))
    for r in rows:
        cut = docs[r.id][1].replace(",", "").lower().split()[r.first_word:r.first_word + r.n_words]
        assert len(cut) == r.n_words and len(set(cut) & set(items[r.item_id][1])) >= 0.9 * len(set(items[r.item_id][1]))
    blocks = {(r.id, r.item_id, r.similarity) for r in dc.matches(frame, bench, block_items=3).collect()}
    assert blocks == {(r.id, r.item_id, r.similarity) for r in rows}
    kept = dc.keep_clean(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d in range(120) if d % 3 == 0}
    assert dc.keep_clean(frame, bench, block_items=3).count() == 40


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, rng.integers(0, 2**63, 40).astype(np.uint64)) for i in range(20)]
    group, = dc.Index(items, 15).groups.values()
    own = group.prints
    flips = np.zeros(5000, np.uint64)
    for k in range(5000):
        for b in rng.choice(64, rng.integers(0, 22), replace=False):
            flips[k] ^= np.uint64(1) << np.uint64(b)
    prints = np.concatenate([own[rng.integers(0, 20, 5000)] ^ flips, rng.integers(0, 2**63, 5000).astype(np.uint64)])
    want = {(w, i) for i in range(20) for w in np.flatnonzero(np.bitwise_count(prints ^ own[i]) <= 15).tolist()}
    assert set(zip(*(x.tolist() for x in group.pairs(prints)))) == want


def test_entries_of_many_items_are_those_of_few(monkeypatch):
    """The table made mask by mask holds what the one made at once holds."""
    rng = np.random.default_rng(4)
    masks = dc.flips(10, 2)
    for n in (5, 300, 2500):
        own = rng.integers(0, 1 << 10, n).astype(np.uint16)
        start, items = dc.entered(own, masks, 1 << 10)
        loop_start, loop_items = dc.entered(np.repeat(own, 20), masks, 1 << 10) if n == 2500 else (20 * start, np.repeat(items, 20))
        assert (loop_start == 20 * start).all()
        for value in range(0, 1 << 10, 37):
            want = np.flatnonzero(np.isin(own ^ value, masks))
            assert sorted(items[start[value]:start[value + 1]]) == want.tolist()
            if n == 2500:
                assert sorted(loop_items[loop_start[value]:loop_start[value + 1]] // 20) == np.repeat(want, 20).tolist()


def test_edge_rows(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, f"x {item} y"), (4, "a " * 60000), (5, "one two")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "one two"), (None, item), (5, "a " * 30)], "item_id long, text string")
    got = sorted((str(r.id), str(r.item_id)) for r in dc.matches(docs, bench).collect())
    assert got == sorted([("3", "1"), ("3", "2"), ("3", "None")] * 2 + [("None", "1"), ("None", "2"), ("None", "None"), ("4", "5")])
    assert sorted(str(r.doc_id) for r in dc.keep_clean(docs, bench).collect()) == ["1", "2", "5"]
    assert dc.matches(docs, bench.limit(0)).count() == 0 and dc.matches(docs.limit(0), bench).count() == 0


def test_items_without_id_and_with_text_ids(spark):
    """A document that holds an item without an id is no clean document, and ids keep their type."""
    docs = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "quite other words are standing here now")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f g")], "item_id long, text string")
    assert [r.doc_id for r in dc.keep_clean(docs, bench).collect()] == [2]
    named = spark.createDataFrame([("q-1", "a b c d e f g"), ("q-1", "a b c d e f g"), ("q-2", "not there at all in them")], "item_id string, text string")
    assert [tuple(r)[:2] for r in dc.matches(docs, named).collect()] == [(1, "q-1")]


def edited(rng, item, similarity):
    """Replace words of ``item`` until its shingles are about as similar as asked."""
    body, want = list(item), similarity
    spots = list(range(len(body)))
    rng.shuffle(spots)
    own = collections.Counter(shingles(" ".join(item)))
    for k in spots:
        body[k] = f"new{rng.randrange(10**6)}"
        now = collections.Counter(shingles(" ".join(body)))
        if (own & now).total() / (own | now).total() < want:
            body[k] = item[k]
    return body


def recall_by_band(spark, max_records=None):
    rng = random.Random(11)
    items, docs = [], []
    for k in range(600):
        item = words(rng, rng.choice([40, 60, 90, 150, 260, 400]))
        similarity = rng.choice([0.8, 0.82, 0.85, 0.9])
        body = words(rng, rng.randrange(0, 120))
        at = rng.randrange(len(body) + 1)
        body[at:at] = edited(rng, item, similarity)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(body)))
    want = {}
    for (d, text), item in zip(docs, items):
        want |= {key: s for key, s in brute([(d, text)], [item]).items()}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.id, r.item_id) for r in dc.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    return want, got


def test_recall_by_similarity(spark):
    """The share of pairs found, by their true similarity: what README states."""
    want, got = recall_by_band(spark)
    bands = {}
    for pair, similarity in want.items():
        band = "0.80-0.82" if similarity < 0.82 else "0.82-0.85" if similarity < 0.85 else "above"
        bands.setdefault(band, []).append(pair in got)
    share = {band: sum(hits) / len(hits) for band, hits in bands.items()}
    print(share, {band: len(hits) for band, hits in bands.items()})
    assert min(len(hits) for hits in bands.values()) >= 60
    assert share["0.80-0.82"] >= 0.94 and share["0.82-0.85"] >= 0.97 and share["above"] >= 0.99


def test_batches_change_nothing(spark):
    """A verdict depends on the document alone, however documents are dealt into batches."""
    rng = random.Random(12)
    items = [(k, words(rng, rng.choice([30, 80, 200]))) for k in range(30)]
    docs = []
    for k in range(150):
        body = words(rng, rng.randrange(0, 60))
        body[len(body) // 2:len(body) // 2] = edited(rng, items[k % 30][1], rng.choice([0.8, 0.81, 0.84]))
        docs.append((k, " ".join(body)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    found = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n, shingle_limit in ((1, 1 << 15), (7, 1 << 15), (10_000, 1 << 15), (10_000, 50)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found.append(sorted(map(tuple, dc.matches(frame, bench, batch_shingles=shingle_limit).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] and all(f == found[0] for f in found)


def test_index_of_a_large_benchmark_is_small():
    rng = np.random.default_rng(3)
    items = [(k, rng.integers(0, 2**63, n).astype(np.uint64)) for k, n in enumerate(rng.integers(20, 200, 50_000))]
    index = dc.Index(items, 15)
    held = sum(a.nbytes for g in index.groups.values() for t in g.tables for a in t[2:])  # starts, items, flags
    assert held < 1000 * len(items)
    shingle_bytes = sum(g.shingles.nbytes + g.times.nbytes for g in index.groups.values())
    assert held + shingle_bytes < 300e6
