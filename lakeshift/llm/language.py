"""Language identification with error-correcting output codes.

Every language has a codeword of plus and minus ones, and every bit of the
code is a binary classifier over hashed character n-grams that tells the
languages with +1 from those with -1. With up to seven languages the code is
the exhaustive one (every way to part them in two), with more it is made of
rows of a Hadamard matrix: any two codewords of length b differ in more than
half of the b bits, so that several classifiers may err on a text.

1. **Count.** Letters are lower-cased and everything between them becomes one
   space. A text adds ``floor(log2 n) + 1`` to the count of an n-gram it has
   n times, so that neither a very long text nor one that repeats itself
   outweighs the others. Counts per language cover all training rows: one
   array per language and task, summed by Spark, integers throughout.
2. **Bit classifiers.** A bit's weight for a bucket is the log ratio of its
   mean smoothed frequency over the languages with +1 to that over those
   with -1: each language counts the same, whatever its share of the rows.
   A text's margin is the mean weight of its n-grams.
3. **Weigh.** A second pass over the training rows measures how often each
   bit classifier is right on texts of each language.
4. **Decode.** The distance of a text to a codeword is the sum over its bits
   of the logistic loss of the margin, weighted by that accuracy; the nearest
   codeword is the prediction (ties: the language that sorts first), and the
   softmax of the negative distances its score. ``ambiguous`` is set if more
   bits disagree with the codeword than the code can correct, or if the
   second codeword is nearer than ``min_gap`` beyond the first.

The model has ``buckets`` times the number of bits weights; more than
``max_languages`` values of the language column are refused, as no list of
languages is that long. Null texts and texts without a letter are ``und``
with score 0 and not ambiguous, as is every text if nothing could be learned.
With one language every text with a letter gets it, score 1. Training rows
without text, letter or language teach nothing. Repeated rows are judged
alike and each counts. Texts are read in blocks, so that memory stays bounded
for very long ones. Other columns are not used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshift.session import ship_package

BUCKETS = 1 << 16
LONGEST = 4
BLOCK = 1 << 19
UNKNOWN = "und"
#: N-grams of margin 0 that join each mean, so that very short texts have small margins.
PRIOR = 4.0
#: Nats of mean margin to units of the logistic loss.
SCALE = 8.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark that belongs to one."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, one space for everything between them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[codes]
    first_gap = ~keep
    first_gap[1:] &= keep[:-1]
    return np.where(keep, codes, 32)[keep | first_gap].astype(np.uint64)


def ngram_buckets(text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of 1 to ``longest`` letters, block by block."""
    before = np.array([32], np.uint64)
    for at in range(0, len(text), BLOCK):
        new = letter_codes(text[at: at + BLOCK])
        if at + BLOCK >= len(text):
            new = np.append(new, np.uint64(32))
        last = np.concatenate([before[-1:], new[:-1]])
        new = new[(new != 32) | (last != 32)]
        codes, known = np.concatenate([before, new]), len(before)
        found = []
        for n in range(1, longest + 1):
            own = codes[max(0, known - n + 1):]
            if len(own) < n:
                continue
            h = own[: len(own) - n + 1] + np.uint64(n << 40)
            for k in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + own[k: len(own) - n + 1 + k]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((h ^ (h >> np.uint64(29))) % np.uint64(buckets))
        before = codes[-(longest - 1):] if longest > 1 else codes[-1:]
        yield np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def features(text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their damped counts."""
    if len(text) <= 4096:
        parts = list(ngram_buckets(text, buckets, longest))
        used, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    else:
        total = np.zeros(buckets, np.int64)
        for part in ngram_buckets(text, buckets, longest):
            total += np.bincount(part, minlength=buckets)
        used = np.flatnonzero(total)
        n = total[used]
    return used, np.frexp(n.astype(np.float64))[1].astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1 and -1, one row each."""
    if n <= 7:
        parts = np.arange(max(0, (1 << max(n - 1, 0)) - 1))
        rows = [np.ones(len(parts))] + [np.where(parts >> i & 1, 1, -1) for i in range(n - 1)]
        return np.array(rows[:n], np.int8).reshape(n, len(parts))
    size = 1 << n.bit_length()
    i, j = np.arange(1, n + 1)[:, None], np.arange(1, size)[None]
    odd = np.zeros((n, size - 1), np.int64)
    for b in range(size.bit_length()):
        odd ^= (i & j) >> b & 1
    return np.where(odd, -1, 1).astype(np.int8)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits, +1 and -1
    weights: np.ndarray   # buckets x bits
    trust: np.ndarray     # languages x bits, rows add up to the number of bits

    def margins(self, text: str) -> np.ndarray:
        used, n = features(text, len(self.weights))
        return SCALE * (n @ self.weights[used]) / (PRIOR + n.sum())

    @property
    def correctable(self) -> int:
        """Wrong bits that still leave the right codeword the nearest."""
        if len(self.languages) < 2:
            return 0
        code = self.code.astype(np.int64)
        differ = (code.shape[1] - code @ code.T) // 2
        return int((differ[~np.eye(len(differ), dtype=bool)].min() - 1) // 2)

    def decode(self, margins: np.ndarray, correctable: int, min_gap: float) -> tuple[str, float, bool]:
        distance = (self.trust * np.logaddexp(0.0, -self.code * margins)).sum(1)
        best = int(distance.argmin())
        share = np.exp(distance[best] - distance)
        wrong = int((np.sign(margins) != self.code[best]).sum())
        gap = np.partition(distance, 1)[1] - distance[best] if len(distance) > 1 else np.inf
        return self.languages[best], float(1.0 / share.sum()), bool(wrong > correctable or gap < min_gap)


def sums(rows: DataFrame, size: int) -> dict[str, np.ndarray]:
    """``rows (lang, slot, n)`` added up to one array of ``size`` numbers per language."""
    def pack(table: pa.Table) -> pa.Table:  # at most ``size`` rows
        out = np.zeros(size, np.int64)
        out[table["slot"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"lang": table["lang"].slice(0, 1), "n": [out.tobytes()]})

    added = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = added.groupBy("lang").applyInArrow(pack, "lang string, n binary").collect()
    return {r.lang: np.frombuffer(r.n, np.int64) for r in found}


def sum_by_language(rows: DataFrame, size: int, vector) -> dict[str, np.ndarray]:
    """The sum over all ``rows (lang, text)`` of ``vector(lang, text)``, which gives slots and numbers or None."""
    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in held.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full), pa.array(total[full])], ["lang", "slot", "n"])
        held.clear()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, found = lang.as_py(), vector(lang.as_py(), text.as_py())
                if found is None:
                    continue
                if lang not in held:
                    if len(held) >= 64:
                        yield from flush(held)
                    held[lang] = np.zeros(size, np.int64)
                held[lang][found[0]] += found[1]
        yield from flush(held)

    return sums(rows.mapInArrow(kernel, "lang string, slot long, n long"), size)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS,
        smoothing: float = 0.5, max_languages: int = 1024) -> Model:
    """The model learned from all rows of ``docs`` that have text and language."""
    ship_package(docs.sparkSession)
    rows = (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
            .filter("lang is not null and text is not null"))
    if rows.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"{lang_col} has more than {max_languages} values: no list of languages")

    def count(lang: str, text: str):
        return features(text, buckets) if has_letter(text) else None

    counts = sum_by_language(rows, buckets, count)
    languages = sorted(counts)
    code = codewords(len(languages))
    if code.shape[1] == 0:
        return Model(languages, code, np.zeros((buckets, 0)), np.zeros(code.shape))
    shares = np.stack([(counts[lang] + smoothing) / (counts[lang].sum() + smoothing * buckets) for lang in languages])
    plus = np.stack([shares[code[:, b] > 0].mean(0) for b in range(code.shape[1])], 1)
    minus = np.stack([shares[code[:, b] < 0].mean(0) for b in range(code.shape[1])], 1)
    model = Model(languages, code, np.log(plus / minus).astype(np.float32), np.ones(code.shape))
    model.trust = trust(rows, model)
    return model


def trust(rows: DataFrame, model: Model) -> np.ndarray:
    """How often each bit is right on the rows of each language; each language's row adds up to the number of bits."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    bits = model.code.shape[1]

    def right(lang: str, text: str):
        if not has_letter(text):
            return None
        model = shared.value
        return slice(None), np.append(np.sign(model.margins(text)) == model.code[model.languages.index(lang)], True)

    found = sum_by_language(rows, bits + 1, right)
    hits = np.stack([found[lang] for lang in model.languages])
    share = hits[:, :bits] / hits[:, bits:]
    total = share.sum(1, keepdims=True)
    return np.where(total > 0, bits * share / np.where(total > 0, total, 1.0), 1.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            min_gap: float = 1.0) -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` per row of ``docs``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        correctable = model.correctable

        def one(text: str | None) -> tuple[str, float, bool]:
            if not text or not model.languages or not has_letter(text):
                return UNKNOWN, 0.0, False
            return model.decode(model.margins(text), correctable, min_gap)

        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(1)]
            lang, score, ambiguous = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(ambiguous, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, lang_pred string, score double, ambiguous boolean")
