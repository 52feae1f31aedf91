"""Benchmark decontamination by SimHash windows.

Texts are lower-cased in A-Z, ASCII punctuation counts as white space, and
words are shingled by five. Windows of an item's length slide over every
document from its first shingle on, an eighth of that length at a time (at
least one shingle), with one more at its end; item lengths within a twentieth
of one another share their windows. A shorter document is one window as a
whole. A document's windows are its own, whatever stands in its batch.

* Fingerprints: a window's 64-bit SimHash is the majority, bit by bit, of its
  shingles' hashes. Running sums of the bits give all windows of a length in
  one pass.
* Multi-index: fingerprints are cut into six blocks of 11 or 10 bits. Within
  ``max_bits`` = 15 bits some block differs in at most two, so that items are
  entered, per length and block, under all values up to two flips away (402
  entries of two bytes an item), and one look-up a block finds every pair
  within the radius. Up to 256 items of a length are entered in four blocks of
  16 bits under all values up to three flips away instead (2788 entries an
  item), which gives fewer pairs to look at.
* Verification: for each pair, the weighted Jaccard similarity of the two
  bags of shingles (each with the number of times it occurs) is computed at
  every alignment between the window and its neighbours; 0.8 or more is a
  match. An item is reported once per document, at its best place (the first
  of several).

What is not certain is that a copy has a window within the radius; the share
of pairs found is measured by similarity in ``tests/llm``.

Documents are read once, in batches joined into one array, and nothing of
them is shuffled. The benchmark is the broadcast side: it is taken in blocks
of about ``block_items`` items, by hash of id and text, each a pass over the
documents. A task holds one block's index, under 1 KB an item beside its
hashes; the driver holds the blocks' hashes (8 bytes a word).

Null and empty texts match nothing; items of fewer than ``min_words`` words
(five at least, the shingle), NULL ones too, match nothing; equal items under
several ids are reported each, items without an id as one whose id is NULL;
repeated rows of documents are matched each; ids may have any type; other
columns are not used.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshift.session import ship_package

SHINGLE = 5
#: Widths of the blocks of a fingerprint, from its low bits on: few wide ones for groups of up to ``FEW`` items,
#: where every look-up is selective, and narrower ones beyond, whose index is small.
WIDE, NARROW, FEW = (16, 16, 16, 16), (11, 11, 11, 11, 10, 10), 256
#: ASCII punctuation and white space become spaces, A-Z become a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles of ``text``; empty if it has fewer words.

    Words are hashed one by one and combined as polynomials with a final mix.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    n = len(words) - shingle + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    value = hashed[:n].copy()
    for k in range(1, shingle):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value += hashed[k: k + n]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def majority(ones: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints from counts of ones, a row of 64 each, among ``size`` bits (one number, or a column)."""
    half = np.asarray(size // 2, ones.dtype)  # 2 * ones > size
    return np.packbits(ones > half, axis=1).view(">u8").ravel().astype(np.uint64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def window_size(n: int, ratio: float = 1.1) -> int:
    """The window for items of ``n`` shingles: lengths within about a twentieth share one."""
    k = round(np.log(n) / np.log(ratio))
    return max(1, round(ratio ** k))


def flips(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``most`` ones."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(width), k)],
                    np.uint16)


def entered(own: np.ndarray, masks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Items under each of their values with a mask applied: where each value's items start, and the items."""
    if len(own) * len(masks) <= 1 << 21:
        keys = (own[:, None] ^ masks).ravel()
        order = np.argsort(keys, kind="stable")
        return np.searchsorted(keys[order], np.arange(size + 1)), (order // len(masks)).astype(np.int32)
    # one mask at a time: all keys at once would take many times the index
    count = np.zeros(size, np.int64)
    for m in masks:
        count += np.bincount(own ^ m, minlength=size)
    start = np.concatenate([[0], np.cumsum(count)])
    items, at = np.empty(start[-1], np.int32), start[:-1].copy()
    for m in masks:
        keys = own ^ m
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        items[at[ranked] + np.arange(len(ranked)) - np.searchsorted(ranked, ranked)] = order
        at += np.bincount(keys, minlength=size)
    return start, items


class Group:
    """Items of one window size: fingerprints, block tables, and their shingles as sorted arrays."""

    def __init__(self, numbers: list[int], hashes: list[np.ndarray], max_bits: int):
        self.numbers, self.max_bits = np.array(numbers, np.int64), max_bits
        self.prints = np.concatenate([majority(bits_of(h).sum(0, dtype=np.int64)[None], np.int64(len(h))) for h in hashes])
        self.tables, shift = [], 0
        self.widths = WIDE if len(hashes) <= FEW else NARROW
        kind = np.uint8 if len(hashes) <= 1 << 8 else np.uint16 if len(hashes) <= 1 << 16 else np.int32
        for width in self.widths:
            masks = flips(width, max_bits // len(self.widths))
            own = (self.prints >> np.uint64(shift)).astype(np.uint16) & np.uint16((1 << width) - 1)
            start, items = entered(own, masks, 1 << width)
            self.tables.append((np.uint64(shift), np.uint16((1 << width) - 1), start.astype(np.int32),
                                items.astype(kind), np.diff(start) > 0))
            shift += width
        parts = [np.unique(h, return_counts=True) for h in hashes]
        self.shingles = np.concatenate([u for u, _ in parts])
        self.times = np.concatenate([n for _, n in parts]).astype(np.int32)
        self.ends = np.cumsum([len(u) for u, _ in parts])
        self.kept: dict[int, Counter] = {}

    def bag(self, item: int) -> Counter:
        """The shingles of an item; those of a few thousand items met last are kept as they are."""
        if item not in self.kept:
            if len(self.kept) >= 4096:
                self.kept.clear()
            part = slice(self.ends[item - 1] if item else 0, self.ends[item])
            self.kept[item] = Counter(dict(zip(self.shingles[part].tolist(), self.times[part].tolist())))
        return self.kept[item]

    def pairs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) numbers within ``max_bits``."""
        found = [np.zeros(0, np.int64)]
        words = prints.astype("<u8").view("<u2").reshape(-1, 4) if self.widths == WIDE else None
        for shift, mask, start, items, some in self.tables:
            value = words[:, int(shift) // 16] if words is not None else (prints >> shift).astype(np.uint16) & mask
            hit = np.flatnonzero(some[value])
            value = value[hit].astype(np.int32)
            lo = start[value]
            n = start[value + 1] - lo
            w = np.repeat(hit, n)
            i = items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(w))].astype(np.int64)
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.max_bits
            found.append(w[near] * len(self.prints) + i[near])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))


class Index:
    """Items by window size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_bits: int):
        by_size = defaultdict(list)
        for number, hashes in items:
            by_size[window_size(len(hashes))].append((number, hashes))
        self.groups = {size: Group([n for n, _ in group], [h for _, h in group], max_bits)
                       for size, group in sorted(by_size.items())}


def best_alignment(hashes: np.ndarray, bag: Counter, size: int, lo: int, hi: int) -> tuple[float, int]:
    """The best weighted Jaccard similarity of ``bag`` and a window of ``size`` that starts in [lo, hi]."""
    window = Counter(hashes[lo: lo + size].tolist())
    common = sum(min(n, bag[h]) for h, n in window.items())
    total, best = sum(bag.values()), (0.0, lo)
    for at in range(lo, hi + 1):
        n = min(size, len(hashes) - at)
        similarity = common / (total + n - common)
        if similarity > best[0]:
            best = (similarity, at)
        if at + size >= len(hashes):
            break
        out, new = int(hashes[at]), int(hashes[at + size])
        common -= window[out] <= bag[out]
        window[out] -= 1
        window[new] += 1
        common += window[new] <= bag[new]
    return best


def grid(sizes: np.ndarray, first: np.ndarray, size: int, step: int) -> np.ndarray:
    """Starts of the windows of ``size`` in joined documents: every ``step`` from each first shingle on, and the last."""
    fit = np.flatnonzero(sizes >= size)
    count = (sizes[fit] - size) // step + 1
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = fit[(sizes[fit] - size) % step > 0]
    return np.concatenate([np.repeat(first[fit], count) + step * within, first[last] + sizes[last] - size])


def match_batch(docs: list[np.ndarray], index: Index, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """``(document, item number, similarity, first word, words)`` of every match in a batch."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return []
    first = np.concatenate([[0], np.cumsum(sizes)])
    joined, doc_of = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
    # Running sums of the 64 bits, several to a 64-bit number: what carries over from one to the next cancels in a
    # difference, as each count in a window fits its part (one byte for windows up to 255).
    part = np.uint8 if max(index.groups, default=0) < 256 else np.uint32
    lanes = bits_of(joined).astype(part, copy=False).view(np.uint64)
    ones = np.zeros((len(joined) + 1, lanes.shape[1]), np.uint64)
    np.cumsum(lanes, axis=0, out=ones[1:])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for size, group in index.groups.items():
        step = max(1, size // 8)
        start = grid(sizes, first, size, step)
        # documents somewhat shorter than the window, as a whole
        short = np.flatnonzero((sizes >= 0.7 * size) & (sizes < size))
        whole = ones[first[short] + sizes[short]] - ones[first[short]]
        inside = ones.take(start + size, 0)
        inside -= ones.take(start, 0)
        prints = np.concatenate([majority(inside.view(part), np.int64(size)),
                                 majority(whole.view(part), sizes[short][:, None])])
        start = np.concatenate([start, first[short]])
        for w, i in zip(*(x.tolist() for x in group.pairs(prints))):
            bag = group.bag(i)
            d, n, number = int(doc_of[start[w]]), bag.total(), int(group.numbers[i])
            at, end = int(start[w] - first[d]), max(0, int(sizes[d]) - n)
            reach = step + abs(n - size)
            lo, hi = max(0, min(at - reach, end)), min(at + reach, end)
            similarity, where = best_alignment(docs[d], bag, n, lo, hi)
            known = best.get((d, number), (0.0, 0))
            if similarity >= threshold and (similarity, -where) > (known[0], -known[1]):
                best[d, number] = (similarity, where, min(n, int(sizes[d])) + SHINGLE - 1)
    return [(d, i, *found) for (d, i), found in best.items()]


def hits_of(texts: pa.Array, index: Index, threshold: float, batch_shingles: int) -> list[tuple]:
    """``match_batch`` over the texts of an Arrow batch, in parts of bounded size."""
    found, at = [], 0
    while at < len(texts) and index.groups:
        part, held, begin = [], 0, at
        while at < len(texts) and held < batch_shingles:
            part.append(shingle_hashes(texts[at].as_py()))
            held += len(part[-1])
            at += 1
        found += [(d + begin, *rest) for d, *rest in match_batch(part, index, threshold)]
    return found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, min_words: int, block_items: int) -> Iterator:
    """The items of the benchmark, at most about ``block_items`` at a time: broadcast (ids, numbered hashes)."""
    spark = benchmark.sparkSession
    items = (benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
             .filter("text is not null").distinct())
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(blocks)) == block).toArrow()
        ids = part.column("item").combine_chunks()
        number: dict = {}  # rows of one id are one item
        hashed = [(number.setdefault(i, k), shingle_hashes(t)) for k, (i, t) in
                  enumerate(zip(ids.to_pylist(), part.column("text").to_pylist()))]
        yield spark.sparkContext.broadcast((ids, [(k, h) for k, h in hashed if len(h) >= max(1, min_words - SHINGLE + 1)]))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", max_bits: int = 15, threshold: float = 0.8,
            min_words: int = SHINGLE, block_items: int = 50_000, batch_shingles: int = 1 << 15) -> DataFrame:
    """``(id, item_id, similarity, first_word, n_words)`` of every item found in a document."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def searched(shared) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, items = shared.value
            index = Index(items, max_bits)
            for batch in batches:
                hits = hits_of(batch.column(1), index, threshold, batch_shingles)
                if hits:
                    d, i, s, f, n = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d, pa.int64())), ids.take(pa.array(i, pa.int64())),
                         pa.array(s, pa.float64()), pa.array(f, pa.int64()), pa.array(n, pa.int64())],
                        ["id", "item_id", "similarity", "first_word", "n_words"])
        return rows.mapInArrow(kernel, f"id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long")

    return reduce(DataFrame.union, [searched(b) for b in item_blocks(benchmark, item_col, item_text_col, min_words,
                                                                     block_items)])


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", max_bits: int = 15, threshold: float = 0.8, min_words: int = SHINGLE,
               block_items: int = 50_000, batch_shingles: int = 1 << 15) -> DataFrame:
    """The rows of ``docs`` in which no item is found; each is judged where it is read, without a shuffle."""
    ship_package(docs.sparkSession)

    def clean(rows: DataFrame, shared) -> DataFrame:
        at = rows.columns.index(text_col)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value[1], max_bits)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in hits_of(batch.column(at), index, threshold, batch_shingles)]] = False
                yield batch.filter(pa.array(keep))
        return rows.mapInArrow(kernel, rows.schema)

    return reduce(clean, item_blocks(benchmark, item_col, item_text_col, min_words, block_items), docs)
