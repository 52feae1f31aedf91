"""WARC archives: exact round trips and broken input."""
import collections
import hashlib
import uuid

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeshift.llm import queries, warc
from lakeshift.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def test_query_matches_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    by = collections.defaultdict(list)
    for p in pages:
        by[(p.html or "").encode()].append(p.page_id)
    want = {}
    for body, ids in by.items():
        for i in ids:
            later = len(body) >= 1000 and i < max(ids)
            want[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if later else "response", max(ids) if later else None)
    got = queries.op1_warc_roundtrip(spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert all(r.verified and r.error is None for r in got)


def test_edge_rows_round_trip(spark, folder):
    evil = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3000
    rows = [(1, "http://a/b c\n", None), (2, None, ""), (3, "u", evil), (None, "v", "y" * 2000), (None, "v", "y" * 2000),
            (4, "w", "\r\n" * 40000), (5, "w", "z" * 5000), (6, "w", "z" * 5000), (6, "w", "z" * 5000), (7, "w", "z" * 999),
            (8, "w", "z" * 999), (9, "w", "é" * 30000)]
    pages = spark.createDataFrame([(*r, "n", 7) for r in rows], "page_id long, url string, html string, digest string, payload int")
    warc.write_archives(pages, folder, segment_bytes=1000)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    whole = collections.Counter((r.row_id, bytes(r.payload or b"")) for r in got if r.record_type == "response")
    assert whole == collections.Counter((i, (h or "").encode()) for i, _, h in rows if i != 5)
    assert [(r.row_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(5, 6)]


@pytest.mark.parametrize("body", [b"", b"a", b"a" * 8192, b"b" * 20001, b"WARC/1.1\r\n" * 5])
def test_chunk_framing(body):
    framed = warc.chunked(body)
    assert warc.dechunked(framed) == body and b"WARC/1.1\r\n" not in framed
    with pytest.raises(ValueError):
        warc.dechunked(framed[:-3])


def test_broken_segments_are_reported(spark, folder):
    pages = spark.createDataFrame([(1, "u", "x" * 9000), (2, "u", "short")], "page_id long, url string, html string")
    warc.write_archives(pages, folder, segment_bytes=1000)
    records = warc.read_records(spark, folder).cache()
    lost = warc.payloads(warc.reassemble(records.filter("segment is null or segment <> 3"))).collect()
    assert {r.row_id: r.error for r in lost} == {1: "segments are missing or repeated", 2: None}
    tail = warc.payloads(warc.reassemble(records.filter("segment is null or total is null"))).collect()
    assert {r.row_id: r.error for r in tail} == {1: "segments and total length differ", 2: None}
    headless = warc.payloads(warc.reassemble(records.filter("segment is null or segment > 1"))).collect()
    assert sorted((str(r.row_id), bool(r.error)) for r in headless) == [("2", False), ("None", True)]


def test_length_mismatch_is_reported():
    assert warc.parse(b"WARC-Type: response\r\nContent-Length: 5\r\n\r\nab")["error"]
    assert warc.parse(b"WARC-Type: response\r\nContent-Length: 2\r\n\r\nab")["error"] is None
    assert warc.parse(b"\r\n") is None


def test_empty_table(spark, folder):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_no_record_is_lost_at_splits(spark, folder):
    pages = spark.createDataFrame([(i, "u", f"{i}\r\n" * (i % 97)) for i in range(600)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), folder, segment_bytes=150)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("997", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read_archives(spark, folder).collect()
            assert sorted(r.row_id for r in got) == list(range(600)) and all(r.error is None for r in got)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("body", [b"see WARC/1.1", b"x" * 8184 + b"WARC/1.1 y", b"WARC/1.1" * 3000])
def test_framing_adds_no_version_line(body):
    framed = warc.chunked(body)
    assert warc.dechunked(framed) == body and b"WARC/1.1" not in framed


def test_version_before_any_cut_round_trips(spark, folder):
    bodies = ["see WARC/1.1", "x" * 8184 + "WARC/1.1 y", *["x" * n + "WARC/1.1 y" + "z" * 9000 for n in range(7180, 7320)]]
    urls = ["http://a/WARC/1.1", "http://a/WARC/1.1/b", "WARC/1.1"]
    rows = [*((i, "u", b) for i, b in enumerate(bodies)), *((1000 + i, u, "short") for i, u in enumerate(urls))]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder,
                        segment_bytes=7300, min_bytes=10 ** 9)
    got = {r.row_id: r for r in warc.read_archives(spark, folder).collect()}
    assert all(r.error is None for r in got.values())
    assert {i: bytes(r.payload).decode() for i, r in got.items()} == {i: b for i, _, b in rows}
    assert [got[1000 + i].target for i in range(3)] == ["http://a/%57ARC/1.1", "http://a/WARC/1.1/b", "%57ARC/1.1"]


def test_large_records_take_linear_time(spark):
    """A record of many segments is joined in one copy: ten times the bytes, not much more than ten times the time."""
    import time

    def seconds(megabytes):
        size = 16384
        n = (megabytes << 20) // size
        parts = spark.range(n).selectExpr(
            "0L as row_id", "'response' as record_type", "'r' as record_id", "'' as target", "null as refers_to",
            "null as payload_length", "null as digest", "cast(id + 1 as int) as segment", "'r' as origin",
            f"if(id = {n - 1}, {n * size}L, null) as total", f"cast(repeat(char(97 + id % 26), {size}) as binary) as block",
            "cast(null as string) as error").select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(warc.PARSED)])
        start = time.perf_counter()
        row = warc.reassemble(parts).selectExpr("octet_length(block) as n", "error", "sha1(block) as h").first()
        assert row.n == n * size and row.error is None
        return time.perf_counter() - start
    seconds(2)
    assert seconds(160) <= 6 * max(seconds(40), 1.0)
