"""Prefix trie against brute force; hash tables, cut conversations, edge rows."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lakeshift.llm import queries, trie

SF = "/root/testdata/sf0.001"


def brute(rows, every=20, most=3):
    """Nodes from dictionaries keyed by whole prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(
                f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32], role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        full[c] = tuple(turns.get(c - c % every, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, path in sorted(full.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1] if p else "")) for p, m in members.items()}
    leaves, total = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            total[p[:d]] += saved[p]
            leaves[p[:d]] += p not in children
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], total[p],
                   hashlib.sha256(",".join(str(c) for c in m if full[c] == p).encode()).hexdigest())
                  for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1) for r in rows], "conv_id long, turn long, role string, text string, depth int")


def made(seed, n, long_one=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "d  e\nf", "", None])))
    if long_one:
        c = 4 * n + 5
        rows += [(c, t, "user", rng.choice(["x y z", "w"])) for t in range(long_one)]
        rows += [(c + 1, t, r, x) for cc, t, r, x in rows if cc == c][: long_one // 2]  # shares half of it
        rows += [(c + 20, t, r, x) for cc, t, r, x in rows if cc == c]
    return rows


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, SF)) == brute(rows)


@pytest.mark.parametrize("shard_rows, long_one", [(500_000, 0), (7, 0), (25, 300)])
def test_shards_cut_anywhere(spark, shard_rows, long_one):
    rows = made(shard_rows, 60, long_one)
    got = trie.prefix_trie(frame(spark, rows), shard_rows=shard_rows)
    assert found(got) == brute(rows)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", x) for c in range(0, 400) for t, x in enumerate(["hello there", "yes", "no no"])]
    rows += [(c, 0, "user", f"other {c}") for c in range(400, 440)]
    assert found(trie.prefix_trie(frame(spark, rows), shard_rows=50)) == brute(rows)


def test_ties_repeats_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "bot", "b"), (1, None, None, None), (1, None, "x", "y"),
            (None, 0, "user", "lost"), (20, 0, "user", "base"), (21, 0, "user", "own"), (47, 0, "u", "only"),
            (61, 5, "user", "w " * 50_000), (62, 1, "", "a"), (3, 0, "user", "a")]
    rows += [(100, 3, "user", "same")] * 90
    for shard_rows in (500_000, 5):
        assert found(trie.prefix_trie(frame(spark, rows), shard_rows=shard_rows)) == brute(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(frame(spark, [(1, 0, "a", "b")]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 50_000])
def test_hash_is_minimal_perfect_and_verified(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
    table = trie.NodeTable(np.repeat(hi, 2), np.repeat(lo, 2))
    slots = table.slots(hi, lo)
    assert sorted(slots.tolist()) == list(range(n))
    assert (table.slots(hi, lo + np.uint64(1)) == -1).all()


def test_accumulate_in_depth_order():
    parent = np.array([-1, 0, 0, 1, 3, -1])
    depth = np.array([0, 1, 1, 2, 3, 7])
    value = np.array([1, 2, 4, 8, 16, 32])
    trie.accumulate(parent, depth, value)
    assert value.tolist() == [31, 26, 4, 24, 16, 32]
