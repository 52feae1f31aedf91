"""Best-fit packing: exact pieces, valid places, and the dominance reduction against exact packing."""
import collections
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeshift.llm import packing, queries

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(docs, capacity=2048):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    out = []
    for d, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    return out


def check_places(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_pieces_and_places(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == collections.Counter(brute_pieces(docs))
    assert check_places(rows, 2048) <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def fewest(lengths, capacity):
    """Exact number of sequences by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                k = rooms.index(room)
                go(i + 1, rooms[:k] + [room - lengths[i]] + rooms[k + 1:])
        go(i + 1, [*rooms, capacity - lengths[i]])
    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    shrunk = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 31])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        fixed, rest = packing.reduce_dominated(collections.Counter(lengths), capacity)
        left = list(itertools.chain.from_iterable([n] * c for n, c in rest.items()))
        used = collections.Counter(left)
        for pattern, times in fixed:
            assert sum(n * k for n, k in pattern) <= capacity and sum(k for _, k in pattern) <= 3
            for n, k in pattern:
                used[n] += k * times
        assert used == collections.Counter(lengths)
        assert sum(t for _, t in fixed) + fewest(left, capacity) == fewest(lengths, capacity)
        shrunk += len(left) < len(lengths)
    assert shrunk > 250


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randrange(1, 65), 64, 33, 1]) for _ in range(2000))
    plan = packing.plan(counts, 64)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern) <= 64 and times > 0
        for n, k in pattern:
            used[n] += n and k * times
    assert used == counts
    sequences, low = sum(t for _, t in plan), math.ceil(sum(n * c for n, c in counts.items()) / 64)
    assert sequences <= max(low, sum(c for n, c in counts.items() if n > 32)) * 1.02 + 1


def test_best_fit_alone_matches_one_by_one():
    """Filling equal sequences together gives what best-fit decreasing gives one piece at a time."""
    rng = random.Random(4)
    for _ in range(100):
        lengths = [rng.randrange(1, 41) for _ in range(60)]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(40 - n)
        assert sum(t for _, t in packing.best_fit(collections.Counter(lengths), 40)) == len(rooms)


def test_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "Tab\there"), (4, "Tab\there"), (None, "Ünïcode İ ß ÿ ½ naïve's o'clock <|endoftext|>"),
             (5, "x" * 500), (6, "á é"), (7, "日本語 text, mixed!!! don't")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id long, text string, length int, piece string")
    rows = packing.pack(docs, WORDS, capacity=256).collect()
    got = collections.Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == collections.Counter(brute_pieces(texts, 256))
    check_places(rows, 256)
    assert packing.pack(docs.limit(0), WORDS).count() == 0
