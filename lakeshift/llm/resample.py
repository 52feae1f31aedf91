"""Importance resampling towards a target distribution.

Features are runs of consecutive words, hashed into a fixed number of
buckets. A bucket's gain is the logarithm of its frequency in the target
over that in the corpus, in thousandths; a document's weight is the sum of
its features' gains, its score the weight plus a Gumbel variate made from a
hash of its id. Taking the highest scores is a draw without replacement in
proportion to ``exp(weight)``.

1. Each task counts its buckets in one array; the sums per bucket, at most
   ``size`` numbers, become one array of gains that every task scores with.
2. The scores are written once. A distributed quickselect then finds the
   k-th key in the order (score descending, id, features, row): random keys
   still in question serve as pivots, one pass counts exactly how many keys
   lie below, at and above each, and the interval that holds the k-th key is
   searched on. Only pivots and counts reach the driver.
3. The winners alone, the keys up to the k-th, are range-partitioned, sorted
   and ranked.

Null and empty texts have no features: weight 0. A document with too few
words is never drawn. Equal scores go to the smaller id, ids that are NULL
(hashed as empty text) last; rows with equal id, score and features are
interchangeable, and each is a row of its own. An empty target or corpus
gives gains by the same formula with counts of 0. Texts are read in blocks
of a bounded size, so very long ones need no more memory than their bytes
and one block's words. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lakeshift.llm.common import stored
from lakeshift.operators.ordering import dense_position
from lakeshift.session import ship_package

#: Words of lower-cased UTF-8: runs of ASCII digits and letters and of all bytes beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
BLOCK = 1 << 20
#: Rank order: the best key is the smallest.
KEY = ("minus_score", "no_id", "id", "n_features", "row")


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that never cut a word."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def feature_buckets(text: bytes | None, size: int, longest: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, buckets of the features that end in them)`` per block of a text."""
    before: list[bytes] = []
    for block in blocks((text or b"").lower()):
        words = WORD.findall(block)
        hashes = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        joined = before + words
        for n in range(2, longest + 1):
            own = joined[max(0, len(before) - n + 1):]
            runs = [zlib.crc32(b" ".join(own[i: i + n])) for i in range(len(own) - n + 1)]
            hashes.append(np.array(runs, np.uint32))
        before = joined[len(joined) - longest + 1:] if longest > 1 else []
        yield len(words), np.concatenate(hashes) % np.uint32(size)


def bucket_counts(texts: DataFrame, text_col: str, size: int, longest: int) -> np.ndarray:
    """How often each bucket occurs in all ``texts``."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), size, longest):
                    total += np.bincount(found, minlength=size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    ship_package(texts.sparkSession)
    rows = texts.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    out = np.zeros(size, np.int64)
    for row in rows.mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n  # at most ``size`` rows
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log frequency ratio of each bucket in thousandths, rounded down."""
    size = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(key: str, seed: int) -> int:
    """A Gumbel variate in thousandths, fixed by ``seed`` and the id's text."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` per row of ``docs``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for i, (key, text) in enumerate(zip(batch.column(1), batch.column(2))):
                for words, found in feature_buckets(text.as_py(), len(gain), longest):
                    out[:3, i] += words, len(found), gain[found].sum()
                out[3, i] = out[2, i] + gumbel(key.as_py(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)],
                                             ["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                       F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, n_words long, n_features long, weight long, score long")


def struct_of(keys: DataFrame, pivot: Row) -> Column:
    """A key on the driver as a literal struct."""
    return F.struct(*[F.lit(pivot[c]).cast(keys.schema[c].dataType).alias(c) for c in KEY])


def kth_key(keys: DataFrame, k: int, total: int, pivots: int = 32, seed: int = 0) -> Row:
    """The ``k``-th smallest (from 1) of ``total`` distinct keys, by quickselect with random pivots.

    A round narrows the interval by about the number of pivots, so rounds
    grow with its logarithm. At most ``pivots`` keys reach the driver at once.
    """
    key = F.struct(*KEY)
    low = high = None
    below, inside, turn = 0, total, 0  # keys up to ``low``, keys between ``low`` and ``high``
    while True:
        part = keys
        if low is not None:
            part = part.filter(key > struct_of(keys, low))
        if high is not None:
            part = part.filter(key < struct_of(keys, high))
        chosen = part.orderBy(F.xxhash64("row", F.lit(seed + turn)), "row").limit(pivots).orderBy(*KEY).collect()
        if inside <= pivots:
            return chosen[k - below - 1]
        counts = part.agg(*[F.count_if(key < struct_of(keys, p)) for p in chosen],
                          *[F.count_if(key == struct_of(keys, p)) for p in chosen]).first()
        bounds = [(below + counts[i], counts[len(chosen) + i], p) for i, p in enumerate(chosen)]
        end = below + inside
        for less, equal, pivot in bounds:
            if less < k <= less + equal:
                return pivot
            if k <= less:
                high, end = pivot, less
                break
            low, below = pivot, less + equal
        inside, turn = end - below, turn + 1


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, size: int = 10_000,
             longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` per row of ``docs``; ``rank`` is NULL for the undrawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a
    hundred are drawn, rounded down. Features are runs of 1 to ``longest``
    words.
    """
    gain = gains(bucket_counts(docs, text_col, size, longest), bucket_counts(target, target_col, size, longest))
    scored = stored(scores(docs, gain, id_col, text_col, longest, seed)
                    .withColumn("minus_score", -F.col("score")).withColumn("no_id", F.col("id").isNull())
                    .withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    total = able.count()
    columns = ["id", "n_words", "n_features", "weight", "score"]
    k = percent * total // 100
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    won = F.struct(*KEY) <= struct_of(scored, kth_key(able.select(*KEY), k, total))
    drawn = (F.col("n_words") >= min_words) & won
    ranked = dense_position(scored.filter(drawn), [], list(KEY), "rank").select(*columns, "rank")
    return scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).union(ranked)
