"""Wavelet shards: round trips and queries of one file."""
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeshift.llm import queries, wavelet
from lakeshift.llm.common import shared_path
from lakeshift.llm.tokens import Encoder
from lakeshift.session import checkpoint_dir

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute(docs):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    at, out = 0, []
    for d, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_matches_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.op6_wavelet_shards(spark, SF).collect())
    assert got == brute(docs)


def test_small_shards_and_edge_rows(spark):
    folder = f"{checkpoint_dir(spark)}/wm-{uuid.uuid4().hex}"
    texts = [(1, None), (2, ""), (3, "word " * 3000), (4, " lead\n\n  two \t tab"), (5, "Ünïcode 日本 don't <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 3, "h") for i, t in texts], "doc_id long, text string, start int, h string")
    shards = wavelet.write_shards(docs, BYTES, folder, shard_ids=5)
    assert shards.count() >= 3
    assert sorted(tuple(r) for r in wavelet.read_shards(shards).collect()) == brute(texts)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = wavelet.read_shards(wavelet.write_shards(twice, BYTES, folder + "2")).collect()
    assert sorted((str(r.id), r.start) for r in rows) == [("1", 2), ("1", 4), ("None", 0)]
    none = wavelet.write_shards(docs.limit(0), BYTES, folder + "3")
    assert none.count() == 0 and wavelet.read_shards(none).count() == 0


@pytest.mark.parametrize("n,top", [(0, 2), (1, 2), (5, 8), (131072, 300), (300001, 50257)])
def test_file_answers_queries(tmp_path, n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    path = tmp_path / "x.wm"
    path.write_bytes(wavelet.dump(ids, ["a", "b"], np.array([0, n // 2, n]), max(1, (top - 1).bit_length())))
    shard = wavelet.Shard.open(str(path))
    assert shard.n == n and (shard.ids() == ids).all() and shard.keys == ["a", "b"]
    for i in rng.integers(0, max(n, 1), min(n, 25)).tolist():
        assert shard.access(i) == ids[i]
    with pytest.raises(IndexError):
        shard.access(n)
    for t in (0, 1, top - 1, top // 2, 70000):
        assert shard.count(t) == (ids == t).sum()
        assert shard.count(t, n // 3, n // 2) == (ids[n // 3:n // 2] == t).sum()
        where = np.flatnonzero(ids[: n // 50 + 3] == t).tolist()
        assert shard.positions(t, 0, min(n, n // 50 + 3)) == where


def masked(ids, bits):
    """Planes as a plain twin makes them, with a mask for each value of a bit."""
    seq, planes = ids.astype(np.uint16), []
    for b in reversed(range(bits)):
        bit = (seq & np.uint16(1 << b)) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        seq = np.concatenate([seq[~bit], seq[bit]])
    return planes


def test_planes_cost_less_than_masks():
    ids = np.random.default_rng(3).integers(0, 50257, 1 << 20).astype(np.uint32)
    planes, zeros = wavelet.build(ids, 16)
    assert all((a == b).all() for a, b in zip(planes, masked(ids, 16), strict=True))
    assert (wavelet.restore(planes, zeros, len(ids)) == ids).all()

    def cost(work):
        times = []
        for _ in range(5):
            start = time.process_time()
            work()
            times.append(time.process_time() - start)
        return min(times)

    plain = cost(lambda: masked(ids, 16))
    assert cost(lambda: wavelet.build(ids, 16)) < 0.7 * plain
    assert cost(lambda: wavelet.restore(planes, zeros, len(ids))) < 0.8 * plain


def test_broken_file_is_refused():
    with pytest.raises(ValueError):
        wavelet.Shard(lambda at, size: b"x" * size)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_ids_equal_whole_text(spark, path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    encoder = Encoder(path, limit=50)
    texts = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "  a\n\n\nb  ", "don't I'll we've", "x.y, z!! (q)", "é é ñ Ñ ß",
             "日本語 と", "12 345 6a7", "\x1ca b", "a b", "a\tb \t c", "ﬁ Ⅷ ½", "🙂 ok", "İstanbul ΣΑΣ", "w" * 300 + " v", "été"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in texts * 2:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:50])


def test_pieces_of_known_characters_need_no_whole_text():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    encoder, taken = Encoder(BYTES), []
    whole = encoder.whole
    encoder.whole = lambda text: taken.append(text) or whole(text)
    texts = ["12.5% of (a-b) x\ny ''s 's it's we'LL 'tis x'' ,'s <|endoftext|>", "né@à.com ###\n%%% 10.0.0.1:80", "_a_b_ ×÷ ª",
             "\n", "\n\n", "a\n\nb", "a\n\n\nb", "a\n", "a\n\n", "\na", "\n\na", "a \n b", "a b ", " \n", "a\n  ", "'s\n's 's"]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert not [t for t in taken if any(c in t for c in "%#.@'_")]
    rng = np.random.default_rng(5)
    for size in rng.integers(1, 25, 4000):
        text = "".join(rng.choice(list("aB é7'st.,_\n\n  ×ll"), size))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["date", "decimal(20,3)", "double", "timestamp", "boolean", "int", "string"])
def test_ids_of_any_type(spark, kind):
    values = {"date": ["2024-01-05", "1999-12-31"], "timestamp": ["2024-01-05 10:00:00", "1999-12-31 00:00:01"],
              "decimal(20,3)": ["12345678901234567.125", "-0.5"], "boolean": ["true", "false"]}.get(kind, ["7", "12"])
    docs = spark.createDataFrame([(v, f"some text {v}") for v in [*values, None]], "doc_id string, text string").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "text")
    shards = wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "ids"))
    back = wavelet.read_shards(shards, kind)
    assert dict(back.dtypes)["id"] == dict(docs.dtypes)["doc_id"]
    assert sorted(str(r.id) for r in back.collect()) == sorted(str(r.doc_id) for r in docs.collect())


def test_schemes_as_spark_names_them(tmp_path):
    assert wavelet.arrow_uri("s3a://bucket/folder/x") == "s3://bucket/folder/x"
    assert wavelet.arrow_uri("hdfs://host/x") == "hdfs://host/x"
    for path in (f"file://{tmp_path}", str(tmp_path)):
        assert wavelet.file_system(path)[1] == str(tmp_path)
