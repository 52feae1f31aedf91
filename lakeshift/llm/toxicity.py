"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (with marks for its start and
end) and itself, hashed into a fixed number of buckets; a word's vector is
the mean of its buckets' embeddings, a document's vector the mean of its
words', and a linear softmax gives the class. Embeddings and softmax are
trained jointly with numpy (mini-batches, momentum, weight decay), so that
misspelt and newly built words share the vectors of the n-grams they have in
common with known ones.

Two things keep a model of many more weights than documents from learning
its documents by heart. In the mean a bucket weighs by the inverse square
root of its usual share of a text, so that rare n-grams are seen beside the
common ones, and buckets of fewer than ``min_docs`` documents weigh nothing.
And weights start at zero and decay, so that what many documents have in
common is learned first. The bias is then set so that 0.5 is the best cut
(by F-beta, beta 1.5) on an inner fold, a fourth of the training rows that a model of the
others scores; the final model learns from all training rows.

Training rows are a bounded sample: at most ``max_clean`` and ``max_toxic``
labelled documents, those with the smallest hash of their id, and one row of
each (the text with the smallest hash, where an id is repeated). Their
n-gram counts are made in Spark tasks and the model is fitted in one task on
that bounded sample. Since the score is linear in the embeddings up to the
softmax, the fitted model is one logit weight per bucket and a bias; each
task scores its documents with those, keeping the sums of recent words.

Null and empty texts, and texts without a word, have the zero vector: their
score is the softmax of the bias. Without labelled rows of both classes
every weight is zero and the bias is 0. Where a document has several labels,
it counts as toxic if any says so. Repeated rows are scored alike; other
columns are not used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshift.llm.common import stored
from lakeshift.session import ship_package

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
NGRAMS = (3, 5)
#: Zero vectors that join each mean, so that a few words alone do not decide.
PRIOR = 30.0


def word_buckets(word: str, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS) -> list[int]:
    """Buckets of the n-grams of ``<word>`` and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[i: i + n] for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in {*grams, marked}]


def damped(n: int) -> float:
    """Weight of a word that a text has ``n`` times."""
    return 1.0 + math.log(n)


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights in its mean."""
    counts = Counter(WORD.findall((text or "").lower()))
    total = PRIOR + sum(damped(n) for n in counts.values())
    weights: dict[int, float] = {}
    for w, n in counts.items():
        own = word_buckets(w, buckets)
        share = damped(n) / (total * len(own))
        for b in own:
            weights[b] = weights.get(b, 0.0) + share
    return np.fromiter(weights, np.int32, len(weights)), np.fromiter(weights.values(), np.float32, len(weights))


def rarity(docs: list[tuple[np.ndarray, np.ndarray]], buckets: int, min_docs: int, norm: float) -> np.ndarray:
    """Weight of each bucket in the mean: the inverse root of its usual share, scaled to documents of length ``norm``."""
    seen, squares = np.zeros(buckets), np.zeros(buckets)
    for idx, val in docs:
        seen[idx] += 1
        squares[idx] += val.astype(np.float64) ** 2
    usual = np.sqrt(squares / max(len(docs), 1))
    gate = np.where(seen >= min_docs, 1 / np.sqrt(np.maximum(usual, 1e-12)), 0.0)
    length = np.sqrt(np.mean([np.sum((val * gate[idx]) ** 2) for idx, val in docs]))
    return (gate * (norm / length if length > 0 else 0.0)).astype(np.float32)


def loss_and_slopes(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, idx: np.ndarray, val: np.ndarray,
                    row: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean cross entropy of a batch, and its slopes along the embeddings, the softmax and the bias.

    ``idx, val, row`` are the batch's buckets, their weights and their documents.
    """
    n, dim = len(y), emb.shape[1]
    small = emb[idx]
    vec = np.stack([np.bincount(row, val * small[:, k], n) for k in range(dim)], 1)
    logits = vec @ out + bias
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean()
    p[np.arange(n), y] -= 1
    p /= n
    back = p @ out.T
    slopes = np.stack([np.bincount(idx, val * back[row, k], len(emb)) for k in range(dim)], 1)
    return float(loss), slopes, vec.T @ p, p.sum(0)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dim: int = 2,
          epochs: int = 12, batch: int = 256, rate: float = 3.0, decay: float = 1e-3, momentum: float = 0.9,
          min_docs: int = 3, norm: float = 1.7, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit weight per bucket and bias, from embeddings and a two-class softmax trained together."""
    rng = np.random.default_rng(seed)
    gate = rarity(docs, buckets, min_docs, norm)
    emb = np.zeros((buckets, dim), np.float32)
    toxic = rng.normal(0, 1, dim) / math.sqrt(dim)
    out, bias = np.stack([-toxic, toxic], 1), np.zeros(2)
    moved = [np.zeros_like(x) for x in (emb, out, bias)]
    for epoch in range(epochs):
        step = rate * (1.02 - epoch / epochs)
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            chosen = order[at: at + batch]
            part = [docs[i] for i in chosen]
            idx = np.concatenate([d[0] for d in part])
            val = np.concatenate([d[1] for d in part]) * gate[idx]
            row = np.repeat(np.arange(len(part)), [len(d[0]) for d in part])
            used, own = np.unique(idx, return_inverse=True)
            _, slopes, *rest = loss_and_slopes(emb[used], out, bias, own, val, row, labels[chosen])
            for m in moved:
                m *= momentum
            moved[0][used] += slopes
            moved[1] += rest[0]
            moved[2] += rest[1]
            emb -= step * (moved[0] + decay * emb)
            out -= step * (0.1 * moved[1] + decay * out)
            bias -= step * moved[2]
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float64) * gate, float(bias[1] - bias[0])


def best_cut(logits: np.ndarray, labels: np.ndarray, beta: float = 1.5, near: float = 0.99) -> float:
    """The logit that parts the classes best by F-beta: the mean of all cuts that come near the highest value.

    A cut lies halfway between two logits. ``beta`` above 1 weighs a toxic
    document that is missed more than a clean one that is caught.
    """
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    if not hits.size or hits[-1] in (0, len(order)):
        return 0.0
    f = (1 + beta ** 2) * hits / (np.arange(1, len(order) + 1) + beta ** 2 * hits[-1])
    sorted_logits = logits[order]
    cuts = (sorted_logits + np.append(sorted_logits[1:], sorted_logits[-1])) / 2
    return float(cuts[f >= near * f.max()].mean())


def train_with_cut(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """``train`` on all rows, with the bias moved to the best cut of an inner fold (every fourth row)."""
    inner = np.arange(len(docs)) % 4 == 3
    weights, bias = train(docs, labels, **options)
    if len(set(labels[inner].tolist())) < 2 or len(set(labels[~inner].tolist())) < 2:
        return weights, bias
    rest, shift = train([d for d, held in zip(docs, inner) if not held], labels[~inner], **options)
    logits = np.array([rest[idx] @ val + shift for (idx, val), held in zip(docs, inner) if held])
    return weights, bias - best_cut(logits, labels[inner])


def sample(labels: DataFrame, max_clean: int, max_toxic: int, id_col: str = "doc_id",
           label_col: str = "toxic") -> DataFrame:
    """``(s_id, y)``: the labelled ids to learn from."""
    rows = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .groupBy(F.col(id_col).alias("s_id")).agg(F.max(F.col(label_col)).cast("int").alias("y")))
    order = [F.xxhash64("s_id"), "s_id"]
    clean = rows.filter("y = 0").orderBy(*order).limit(max_clean)
    return clean.union(rows.filter("y = 1").orderBy(*order).limit(max_toxic))


def fit(docs: DataFrame, labels: DataFrame, max_clean: int = 4000, max_toxic: int = 2000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", **options) -> tuple[np.ndarray, float]:
    """Logit weight per bucket and bias, learned from a bounded sample of ``labels``."""
    ship_package(docs.sparkSession)
    chosen = stored(sample(labels, max_clean, max_toxic, id_col, label_col), "sample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most max_clean + max_toxic ids, and one row of each
    marked = (rows.join(F.broadcast(chosen), rows.id == chosen.s_id).groupBy("id", "y")
              .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")))
    buckets = options.get("buckets", BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: a text has up to ``buckets`` entries
                idx, val = features(batch.column(2)[i].as_py(), buckets)
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([idx.tobytes()]), pa.array([val.tobytes()])],
                    ["id", "y", "idx", "val"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(zlib.crc32(r["idx"]), r["idx"], r["val"], r["y"]) for b in batches for r in b.to_pylist()]
        found.sort()  # an order of the texts' own, so that ids decide nothing
        known = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for _, a, b, _ in found]
        y = np.array([r[3] for r in found], np.int64)
        weights, bias = np.zeros(buckets), 0.0
        if len(set(y.tolist())) == 2:
            weights, bias = train_with_cut(known, y, **options)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = stored(marked.mapInArrow(count, f"id {kind}, y int, idx binary, val binary"), "counted")
    # the sample is bounded, so is this task
    row = counted.coalesce(1).mapInArrow(learn, "weights binary, bias double").first()
    return (np.frombuffer(row.weights), row.bias) if row else (np.zeros(buckets), 0.0)


class Sums(dict):
    """Logit weight of a word: the mean over its buckets."""

    def __init__(self, weights: np.ndarray, limit: int = 300_000):
        super().__init__()
        self.weights, self.buckets, self.limit = weights.tolist(), len(weights), limit

    def __missing__(self, word: str) -> float:
        own = word_buckets(word, self.buckets)
        found = sum([self.weights[b] for b in own]) / len(own)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found


def logit(text: str | None, sums: Sums, bias: float) -> float:
    counts = Counter(WORD.findall((text or "").lower()))
    weights = [damped(n) for n in counts.values()]
    return bias + sum([a * sums[w] for a, w in zip(weights, counts)]) / (PRIOR + sum(weights))


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(id, score)``, from 0 to 1, per row of ``docs``."""
    ship_package(docs.sparkSession)
    # one number per bucket, however large the corpus
    model = docs.sparkSession.sparkContext.broadcast((np.asarray(weights, np.float64), float(bias)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        sums = Sums(w)
        for batch in batches:
            logits = np.array([logit(t.as_py(), sums, b) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))))],
                                             ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"id {rows.schema['id'].dataType.simpleString()}, score double")
