"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into segments of ``segment_bits`` bits; the bit
counts of the segments are a point of an integer grid. Flipping one bit moves
one coordinate by one, so the Manhattan distance of two points never exceeds
the Hamming distance of their fingerprints. Fingerprints within two bits
therefore have points within Manhattan distance two, and such points share a
grid cell that is at most one step from each. Each distinct fingerprint is
entered in the cells at most one step from its point (33 cells for 4-bit
segments), and fingerprints meet in shared cells:

* a cell with one fingerprint is dropped,
* a cell with two gives that pair, kept if its Hamming distance is in range,
* a cell with more is refined: each of its fingerprints is entered once more
  under the fingerprints at most one bit away that lie in this cell. Two
  fingerprints differ in at most two bits if and only if they share such a
  midpoint, and a midpoint has at most 65 neighbours, so links are a star of
  at most 65 rows and no cell is ever expanded into all its pairs.

Copies never enter this search: it works on distinct fingerprints, counted
before any shuffle of documents. Components come from alternating star
contractions over the links between distinct fingerprints, with each round
written to the shared folder.

Null text counts as empty; texts without words have fingerprint zero, linked
like any other; texts with fewer words than a shingle use their whole word
sequence; repeated rows are rows of their own that get the same component;
rows with a NULL id are kept, with a component of the other ids, or NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshift.llm.common import stored
from lakeshift.session import ship_package

BITS = 64


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1:].tolist()
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[part: part + 65536].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``(id, fp)`` per row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64,
                              batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, fp long")


def signed(value: int) -> int:
    """A 64-bit pattern as the long that holds it."""
    return value - (1 << BITS) if value >> (BITS - 1) else value


def segment_counts(fp: Column, segment_bits: int = 4) -> Column:
    """Bit counts of the segments, each in its own segment of a long."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # pairs without a carry out of the sign bit, then plain sums
    value = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        if width < segment_bits:
            value = value.bitwiseAND(F.lit(mask)) + F.shiftrightunsigned(value, width).bitwiseAND(F.lit(mask))
    return value


def enter(distinct: DataFrame, segment_bits: int = 4) -> DataFrame:
    """``(fp, cell)`` for the grid cells at most one step from the point of each ``fp``."""
    field = (1 << segment_bits) - 1
    steps = F.sequence(F.lit(0), F.lit(2 * BITS // segment_bits))  # 0 stays, odd goes up, even goes down
    rows = (distinct.select("fp", segment_counts(F.col("fp"), segment_bits).alias("point"))
            .select("fp", "point", F.explode(steps).alias("step"))
            .withColumn("shift", F.expr(f"int((step - 1) div 2) * {segment_bits}"))
            .withColumn("count", F.expr(f"shiftrightunsigned(point, shift) & {field}L"))
            .withColumn("moved", F.expr("count + if(step % 2 = 1, 1, -1)"))
            .filter(f"step = 0 or moved between 0 and {segment_bits}"))
    cell = F.expr(f"if(step = 0, point, (point & ~shiftleft({field}L, shift)) | shiftleft(moved, shift))")
    return rows.select("fp", cell.alias("cell"))


def flips() -> Column:
    """Zero and the 64 single-bit masks."""
    return F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)).cast("long") for b in range(BITS)))


def links(distinct: DataFrame, max_bits: int = 2, segment_bits: int = 4) -> DataFrame:
    """Links ``(a, b)``, ``a < b``, between distinct fingerprints (column ``fp``).

    Connected fingerprints stay connected: every pair within ``max_bits`` is
    either linked or linked through a common neighbour within ``max_bits``.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    if segment_bits not in (2, 4, 8):
        raise ValueError("segment_bits is 2, 4 or 8")
    spark = distinct.sparkSession
    if max_bits == 0:
        return spark.createDataFrame([], "a long, b long")
    entered = enter(distinct, segment_bits)
    shared = (entered.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
              .filter("n > 1"))
    shared = stored(shared, "cells")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = shared.filter("n = 2").select("a", "b").filter(within)
    crowded = shared.filter("n > 2").select("cell")
    members = entered.join(crowded, "cell", "left_semi")
    mid = F.col("fp").bitwiseXOR(F.col("flip"))
    midpoints = (members.select("fp", "cell", F.explode(flips()).alias("flip"))
                 .select("fp", "cell", mid.alias("mid"))
                 .filter(segment_counts(F.col("mid"), segment_bits) == F.col("cell")))
    stars = (midpoints.groupBy("mid").agg(F.collect_set("fp").alias("near")).filter("size(near) > 1"))
    if max_bits == 2:  # any two neighbours of a midpoint are within two bits
        stars = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a < b")
    else:  # only the midpoint itself is within one bit of its neighbours
        stars = (stars.filter("array_contains(near, mid)").select("mid", F.explode("near").alias("other"))
                 .select(F.least("mid", "other").alias("a"), F.greatest("mid", "other").alias("b")))
    return pairs.union(stars.filter(within)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star steps: about log2 of the longest
    path rounds. Each round is stored; only its row count and an order-free
    checksum of its edges reach the driver.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # rows are (a, b) with a < b: b hangs below a
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("low"))
        large = (both.filter("b > a").join(low, both.a == low.node)
                 .select(F.col("low").alias("a"), "b").filter("a < b").distinct())
        parent = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        joined = large.join(parent, large.b == parent.node)
        small = (joined.select(F.col("low").alias("x"), F.col("a").alias("y"))
                 .union(parent.select(F.col("low").alias("x"), F.col("node").alias("y")))
                 .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        edges = stored(small, "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return (edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
            .union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    seed: int = 42, max_bits: int = 2, segment_bits: int = 4) -> DataFrame:
    """One row ``(id, fp, component)`` per row of ``docs``.

    ``component`` is the smallest id among documents reachable by links of at
    most ``max_bits`` differing bits. ``segment_bits`` trades entries for
    selectivity: 4 gives 33 entries a fingerprint and cells of about 30 bits,
    2 gives 65 entries and about 45 bits, for corpora of billions.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    # one row per distinct fingerprint before anything else is shuffled
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), max_bits, segment_bits))
    linked = roots.join(classes, roots.node == classes.fp)
    lowest = linked.groupBy("root").agg(F.min("first").alias("component"))
    moved = linked.join(lowest, "root").select("fp", "component")
    labels = stored(classes.join(moved, "fp", "left")
                    .select("fp", F.coalesce("component", "first").alias("component")), "labels")
    return prints.join(labels, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without later members of a near-duplicate group.

    Of each component the document with the smallest id stays (ids that are
    NULL come last, then the text's hash decides). Rows equal in id and text
    are one document, of which the first in the order of all columns stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")]
    found = near_duplicates(docs.select(F.struct(*keys).alias("key"), text.alias("text")), "key", "text", **options)
    firsts = stored(found.filter("id = component").groupBy("id").agg(F.count("*").alias("n"))
                    .select("id.id", "id.hash", "n"), "firsts")

    def of(chosen: DataFrame) -> DataFrame:
        kept = chosen.select(F.col("id").alias("kept_id"), F.col("hash").alias("kept_hash"))
        same = F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.xxhash64(text) == F.col("kept_hash"))
        return docs.join(kept.hint("shuffle_hash"), same, "left_semi")  # texts are shuffled, not sorted

    if firsts.filter("n > 1").isEmpty():
        return of(firsts)
    again = of(firsts.filter("n > 1"))
    one = (again.groupBy(F.col(id_col).alias("kept_id"), F.xxhash64(text).alias("kept_hash"))
           .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return of(firsts.filter("n = 1")).unionByName(one)
