"""SimHash near-dedup against brute force."""
import itertools
import random

import pytest
import xxhash

from lakeshift.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, max_bits):
    """``prints``: list of (id, fp); smallest reachable id per row."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= max_bits:
            parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        low[find(i)] = min(d, low.get(find(i), d))
    return [low[find(i)] for i in range(len(prints))]


def test_query_matches_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, brute_print(d.text)) for d in docs]
    comps = brute_components(prints, 2)
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(prints, comps)}


@pytest.mark.parametrize("max_bits,segment_bits", [(0, 4), (1, 4), (2, 4), (2, 2), (2, 8)])
def test_components_on_dense_fingerprints(spark, max_bits, segment_bits):
    """Chains and crowded cells: fingerprints a few flips around a few centres, with extreme bits."""
    rng = random.Random(5)
    fps = {0, 2**64 - 1, 2**63, 1}
    for centre in (0, 2**64 - 1, rng.getrandbits(64)):
        for _ in range(60):
            fp = centre
            for _ in range(rng.randrange(5)):
                fp ^= 1 << rng.choice([0, 1, 2, 3, 4, 5, 17, 40, 62, 63])
            fps.add(fp)
    prints = [(i, fp) for i, fp in enumerate(sorted(fps))]
    rows = [(simhash.signed(fp),) for _, fp in prints]
    frame = spark.createDataFrame(rows, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, max_bits, segment_bits)).collect()}
    mine = [roots.get(simhash.signed(fp), simhash.signed(fp)) for _, fp in prints]
    want = brute_components(prints, max_bits)
    pairs = itertools.combinations(range(len(prints)), 2)
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i, j in pairs)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (4, "ONE  two\n", "x"), (5, "a b c d", "x"),
            (5, "a b c d", "x"), (None, "quite other words stand here", "x"), (6, "w " * 70000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.id), r.fp, r.component) for r in simhash.near_duplicates(docs).collect())
    by = {(i, fp): c for i, fp, c in got}
    assert by[("1", 0)] == by[("2", 0)] == 1
    assert {c for (i, _), c in by.items() if i in "34"} == {3}
    assert len(got) == len(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0


def test_arguments(spark):
    frame = spark.createDataFrame([], "fp long")
    with pytest.raises(ValueError):
        simhash.links(frame, 3)
    with pytest.raises(ValueError):
        simhash.links(frame, 2, 5)
