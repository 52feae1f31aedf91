"""Packing documents into sequences of a fixed token length.

Documents longer than a sequence are cut into whole sequences and a rest;
every other piece stays whole. How pieces share sequences depends on lengths
only, so the instance is the histogram of lengths: at most ``capacity``
rows, whatever the corpus. On it:

* Dominance reduction (Martello and Toth): for a piece, from the longest
  down, a set of at most three pieces is fixed for good if every other set
  with that piece is dominated, that is, can be exchanged for it without
  needing more room elsewhere. Four cases are proved on the lengths at hand:
  nothing fits beside it; one piece fills the rest exactly; the longest
  piece that fits is as long as any set that fits; or, where at most two
  more fit, two pieces that cover any such two. What is fixed leaves the
  instance, which shrinks, until nothing more is proved.
* Best-fit decreasing for the remainder: each length goes to the fullest
  open sequences that still hold it, many equal sequences at a time.

The result is a list of fill patterns with counts. Pieces of one length are
interchangeable: they are numbered in Spark (within length and salted
bucket, so that a frequent length is spread over many tasks) and the k-th
piece of a length takes the k-th place for that length.

Null text counts as empty: a document of the end id alone. Repeated rows are
documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshift.llm.common import stored
from lakeshift.llm.tokens import encoder
from lakeshift.session import ship_package

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed patterns with their counts, and what remains of ``counts``."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(*pieces: int) -> None:
        need = Counter(pieces)
        times = min(left[n] // k for n, k in need.items())
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))

    def longest_within(room: int, without: Counter) -> int:
        """The longest length at most ``room`` with a piece besides those in ``without`` (0: none)."""
        i = bisect.bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] <= without[lengths[i]]:
            i -= 1
        return lengths[i] if i >= 0 else 0

    def shortest(k: int, without: Counter) -> list[int]:
        found: list[int] = []
        for n in lengths:
            found += [n] * min(k - len(found), max(0, left[n] - without[n]))
            if len(found) == k:
                break
        return found

    def best_two(room: int, without: Counter) -> int:
        """The largest sum of two pieces at most ``room`` (0: none)."""
        lo, hi, best = 0, bisect.bisect_right(lengths, room) - 1, 0
        while 0 <= lo <= hi:
            a, b = lengths[lo], lengths[hi]
            if left[a] <= without[a]:
                lo += 1
            elif left[b] <= without[b] or a + b > room:
                hi -= 1
            elif lo == hi:
                if left[a] - without[a] >= 2:
                    best = max(best, a + b)
                break
            else:
                best = max(best, a + b)
                lo += 1
        return best

    def reduce_one(j: int) -> bool:
        """Fix a set with ``j`` if one dominates all others that hold it."""
        room, own = capacity - j, Counter([j])
        k = longest_within(room, own)
        if not k:
            take(j)
            return True
        small = shortest(3, own)
        two_fit = len(small) >= 2 and small[0] + small[1] <= room
        three_fit = len(small) == 3 and sum(small) <= room
        if k == room or not two_fit or (not three_fit and best_two(room, own) <= k):
            take(j, k)
            return True
        if not three_fit:
            second = longest_within(room - k, own + Counter([k]))
            # of any two that fit, the longer is at most k and the shorter at most half the room
            if second and second >= longest_within(room // 2, own):
                take(j, k, second)
                return True
        return False

    found = True
    while found:  # what was fixed may have made other sets provable
        found = False
        for j in sorted(left, reverse=True):
            while j in left and reduce_one(j):
                found = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram; equal sequences are filled together."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times and room == 0:
            done.append((pattern, times))
        elif times:
            if room not in open_by_room:
                bisect.insort(rooms, room)
                open_by_room[room] = []
            open_by_room[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, times = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(i)
            else:
                room, pattern, times = capacity, (), n
            each = room // length  # the fullest sequence that holds one is the same again
            full = min(times, n // each)
            put(room - each * length, (*pattern, (length, each)), full)
            n -= full * each
            times -= full
            if n and n < each and times:
                put(room - n * length, (*pattern, (length, n)), 1)
                n, times = 0, times - 1
            if pattern:
                put(room, pattern, times)
    return done + [p for group in open_by_room.values() for p in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with counts that hold every piece of the histogram."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every document."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = memoryview(encode.ids(text.as_py()) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    which.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def numbered(found: DataFrame, salt: int = 64) -> DataFrame:
    """``found`` with ``rank``: 0, 1, ... within each length.

    Rows of a length are spread over ``salt`` buckets, numbered inside each,
    and shifted by the sizes of the buckets before. The table of sizes has at
    most ``capacity * salt`` rows.
    """
    salted = found.withColumn("bucket", F.pmod(F.xxhash64(*found.columns), F.lit(salt)).cast("int"))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
                   "bases")
    inside = Window.partitionBy("length", "bucket").orderBy(*found.columns)
    ranked = salted.withColumn("k", F.row_number().over(inside) - 1)
    return ranked.join(bases, ["length", "bucket"]).select(*found.columns, (F.col("base") + F.col("k")).alias("rank"))


def place(ranked: DataFrame, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """``ranked`` with ``sequence_id`` and ``offset``; ``patterns`` is bounded by the capacity."""
    taken: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.setdefault(length, []).append((taken[length], each, sequence, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    table = {n: np.array(r, np.int64).T for n, r in rows.items()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            where, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                first, each, seq, off = table[int(n)]
                i = np.searchsorted(first, rank[here], "right") - 1
                copy, slot = np.divmod(rank[here] - first[i], each[i])
                where[here], offset[here] = seq[i] + copy, off[i] + slot * n
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(where), pa.array(offset)],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(kernel, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per piece ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    found = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    # at most ``capacity`` rows
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(numbered(found), plan(counts, capacity))
