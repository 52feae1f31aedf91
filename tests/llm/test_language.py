"""Output-code language identification: held-out accuracy, a plain twin, codes, edge rows."""
import collections
import math
import unicodedata
import zlib

import numpy as np
import pytest

from lakeshift.llm import language, queries

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    known = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_output_codes(spark, SF).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and known[r.doc_id][0] is not None and r.lang_pred != "und"]
    right = [r for r in held if r.lang_pred == known[r.doc_id][0]]
    assert len(right) >= 0.97 * len(held)
    assert {r.lang_pred for r in rows} <= {lang for lang, _ in known.values()} | {"und"}
    sure = [r for r in held if not r.ambiguous]
    assert sum(r.lang_pred == known[r.doc_id][0] for r in sure) / len(sure) >= len(right) / len(held)


def plain_features(text, buckets, longest=4):
    """Damped counts of the n-grams, letter by letter."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    codes = [ord(c) for c in " " + " ".join(kept.split(" ")).strip() + " "]
    codes = [c for i, c in enumerate(codes) if c != 32 or i == 0 or codes[i - 1] != 32]
    mask, out = (1 << 64) - 1, collections.Counter()
    for n in range(1, longest + 1):
        for i in range(len(codes) - n + 1):
            if n == 1 and i == 0:
                continue  # the space in front starts n-grams, but is none
            h = codes[i] + (n << 40)
            for k in range(1, n):
                h = (h * 0x9E3779B97F4A7C15 + codes[i + k]) & mask
            h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & mask
            out[(h ^ h >> 29) % buckets] += 1
    return {b: n.bit_length() for b, n in out.items()}


def plain_predict(rows, tests, buckets, smoothing=0.5):
    """The whole method with dictionaries."""
    taught = [(lang, plain_features(t, buckets)) for t, lang in rows
              if t and lang is not None and any(map(str.isalpha, t))]
    langs = sorted({lang for lang, _ in taught})
    counts = {lang: collections.Counter() for lang in langs}
    for lang, found in taught:
        counts[lang].update(found)
    parts = (1 << (len(langs) - 1)) - 1
    code = {lang: [1 if i == 0 or p >> (i - 1) & 1 else -1 for p in range(parts)] for i, lang in enumerate(langs)}

    def share(lang, b):
        return (counts[lang][b] + smoothing) / (sum(counts[lang].values()) + smoothing * buckets)

    def margins(found):
        out = []
        for p in range(parts):
            plus, minus = ([x for x in langs if code[x][p] == s] for s in (1, -1))
            total = sum(n * math.log((sum(share(x, b) for x in plus) / len(plus))
                                     / (sum(share(x, b) for x in minus) / len(minus))) for b, n in found.items())
            out.append(8.0 * total / (4.0 + sum(found.values())))
        return out
    right = {lang: [[m * c > 0 for m, c in zip(margins(f), code[lang])] for x, f in taught if x == lang] for lang in langs}
    trust = {lang: [sum(col) / len(col) for col in zip(*right[lang])] for lang in langs}
    out = []
    for text in tests:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        m = margins(plain_features(text, buckets))
        far = {lang: sum(parts * a / sum(trust[lang]) * math.log1p(math.exp(-c * x)) for a, c, x in
                         zip(trust[lang], code[lang], m)) for lang in langs}
        best = min(langs, key=lambda x: (far[x], x))
        out.append((best, 1 / sum(math.exp(far[best] - d) for d in far.values())))
    return out


def test_matches_plain_twin(spark):
    docs = [(r.doc_id, r.text[:400], r.lang) for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(50).collect()]
    docs += [(900, None, "en"), (901, "12 34 !?", "de"), (902, "", "fr"), (903, "Straße Ärger", None), (904, "été", "fr")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit(frame, buckets=512)
    got = {r.id: r for r in language.predict(frame, model).collect()}
    want = plain_predict([(t, lang) for _, t, lang in docs], [t for _, t, _ in docs], 512)
    for (i, _, _), (lang, score) in zip(docs, want):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 15, 16, 40, 176])
def test_codewords_stand_apart(n):
    code = language.codewords(n).astype(int)
    differ = (code.shape[1] - code @ code.T) // 2
    least = differ[~np.eye(n, dtype=bool)].min()
    assert code.shape[0] == n and 2 * least > code.shape[1]
    assert all(len(set(col)) == 2 for col in code.T)


def test_decoding_corrects_wrong_bits():
    code = language.codewords(8)
    model = language.Model([str(i) for i in range(8)], code, np.zeros((1, code.shape[1])), np.ones(code.shape))
    assert model.correctable == 3
    margins = 4.0 * code[5].astype(float)
    margins[:3] *= -0.5
    assert model.decode(margins, model.correctable, 1.0)[::2] == ("5", False)
    margins[3:5] *= -0.2
    assert model.decode(margins, model.correctable, 1.0)[::2] == ("5", True)


def test_blocks_change_nothing(monkeypatch):
    text = "Ein Wort, zwei Wörter; 12 ...   und mehr? " * 30
    whole = language.features(text)
    for size in (1, 3, 7, 100):
        monkeypatch.setattr(language, "BLOCK", size)
        part = language.features(text)
        assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])


def test_edge_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "1234 ...", "de", "x"), (4, "the " * 300_000, "en", "x"),
            (5, "the house", "en", "x"), (5, "the house", "en", "x"), (None, "das Haus", "de", "x"),
            (6, "unlabelled", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.id in (4, 5)} == {"en"} and len({r.score for r in got if r.id == 5}) == 1
    assert [r.lang_pred for r in got if r.id is None] == ["de"]
    one = language.fit(docs.filter("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, one).collect()} == {("und", 0.0), ("de", 1.0)}
    none = language.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, none).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), model).count() == 0


def test_no_list_of_languages(spark):
    docs = spark.range(20).selectExpr("id as doc_id", "'text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language.fit(docs, max_languages=10)
    model = language.fit(docs, max_languages=20, buckets=64)
    assert len(model.languages) == 20 and model.code.shape == (20, 31)
