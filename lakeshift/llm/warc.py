"""WARC archives: writing, and reading with segment reassembly.

Writing: each row becomes a ``response`` record (an HTTP message whose body
is chunk-framed) or, where its payload equals that of another row, a
``revisit`` record without a body. A block longer than ``segment_bytes`` is
written as a first segment and ``continuation`` records. Spark's text writer
stores one record per row with the record end as line separator, so that
output goes through its commit protocol and lost tasks leave nothing behind.

Reading: archives are split at record starts by Spark's text reader, so a
large file is read by many tasks. Each record is checked against its
Content-Length. Continuations are grouped by the id of their origin, ordered
by segment number and joined to its block; numbering must run from 1 without
a gap and the joined length must be the WARC-Segment-Total-Length of the
last segment. Only segmented records are shuffled, and a group is one
record. Chunk framing is then decoded. A record that fails a check is
returned with ``error`` and without payload; nothing is dropped.

The separator, the version line that starts each record, cannot occur inside
a written record: the writer ends a chunk within any ``WARC/1.1`` of the body,
whatever follows it there (the framing and a segment's end add line ends of
their own), and writes a target that ends in it as ``%57ARC/1.1``, which is
the same URI. Foreign archives that hold one inside a block fail the length
check of that record.

Null payloads are empty bodies; a NULL url is written as an empty target;
rows without id are written and read back without one; repeated rows are
records of their own; an empty table gives archives without records.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshift.llm.common import stored
from lakeshift.session import ship_package

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
CHUNK = 8192
RECORD = pa.schema([("record", pa.binary())])
PARSED = ("row_id long, record_type string, record_id string, target string, refers_to long, payload_length long, "
          "digest string, segment int, origin string, total long, block binary, error string")
PARSED_ROW = pa.schema([
    ("row_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()),
    ("refers_to", pa.int64()), ("payload_length", pa.int64()), ("digest", pa.string()), ("segment", pa.int32()),
    ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())])


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in chunk framing, with a chunk end inside every ``VERSION``."""
    cuts = {*range(size, len(body), size), *(m.start() + 2 for m in re.finditer(re.escape(VERSION), body))}
    out, at = [], 0
    for cut in [*sorted(cuts), len(body)]:
        if cut > at:
            out += [b"%x\r\n" % (cut - at), body[at:cut], b"\r\n"]
            at = cut
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body of chunk framing; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is cut off")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size: at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(framed[at: at + size])
        at += size + 2


def header(*fields: tuple[str, object]) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def records_of(row: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of one row, without the empty lines after each."""
    record_id = f"<urn:uuid:{uuid.uuid4()}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target"] or "")
    target = re.sub(rf"W(?={re.escape(VERSION.decode())[1:]}\Z)", "%57", target)
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("X-Row-Id", row["row_id"]),
              ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Payload-Length", row["payload_length"])]
    if row["refers_to"] is not None:
        yield header(("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common,
                     ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                     ("WARC-Refers-To", f"<urn:row:{row['refers_to']}>"), ("Content-Length", 0))
        return
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(row["payload"] or b""))
    kind = [("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield header(("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, *kind,
                     ("Content-Length", len(block))) + block
        return
    cuts = [block[at: at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    for k, part in enumerate(cuts, 1):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, *kind] if k == 1 else [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", record_id)]
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(cuts) else []
        yield header(*own, ("WARC-Segment-Number", k), *last, ("Content-Length", len(part))) + part


def revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``rows (row_id, target, payload, digest, payload_length)`` with ``refers_to``.

    Of rows with equal payloads of ``min_bytes`` or more, those with the
    largest id are responses; the others refer to that id.
    """
    thin = rows.filter(F.col("payload_length") >= min_bytes).select("row_id", "digest")
    latest = (thin.groupBy("digest").agg(F.max("row_id").alias("latest"), F.min("row_id").alias("least"),
                                         F.count("*").alias("n")).filter("n > 1 and latest is not null"))
    seen = (thin.join(latest.select("digest", "latest"), "digest").filter("row_id < latest")
            .select(F.col("row_id").alias("r_id"), F.col("digest").alias("r_digest"), "latest").distinct())
    # stored, so that a small list is seen as small before payloads would be shuffled for the join
    seen = stored(seen, "revisits")
    same = (rows.row_id == seen.r_id) & (rows.digest == seen.r_digest)
    return rows.join(seen, same, "left").select(*rows.columns, F.col("latest").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", segment_bytes: int = 16384, min_bytes: int = 1000,
                   records_per_file: int = 200_000) -> None:
    """Write one record per row of ``pages`` to archives under ``path``."""
    ship_package(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("target"),
                        payload.alias("payload"))
    rows = (rows.withColumn("digest", F.sha1("payload"))
            .withColumn("payload_length", F.octet_length("payload").cast("long")))
    marked = (revisits(rows, min_bytes)
              .withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # batches of bounded size
                made = [r for row in batch.slice(i, 64).to_pylist() for r in records_of(row, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=RECORD)

    (marked.mapInArrow(kernel, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path))


def parse(data: bytes) -> dict | None:
    """Fields of one record as the text reader splits it; None for what stands before the first record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.strip():
        return None
    fields = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    length = number("content-length")
    error = None
    if length is None or len(rest) < length or rest[length:] not in (b"", b"\r\n", b"\r\n\r\n"):
        error = "block and Content-Length differ"
    refers = re.fullmatch(r"<urn:row:(-?\d+)>", fields.get("warc-refers-to", ""))
    return {"row_id": number("x-row-id"), "record_type": fields.get("warc-type"),
            "record_id": fields.get("warc-record-id"), "target": fields.get("warc-target-uri"),
            "refers_to": int(refers[1]) if refers else None, "payload_length": number("x-payload-length"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "segment": number("warc-segment-number"),
            "origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")),
            "total": number("warc-segment-total-length"), "block": rest[:length], "error": error}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, segments apart."""
    ship_package(spark)
    # The separator must not begin with what may stand before it: a reader that starts inside a run of
    # line ends could otherwise lose the record after it.
    lines = (spark.read.option("lineSep", f"{VERSION.decode()}\r\n").text(path)
             .select(F.col("value").cast("binary").alias("data")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                found = [parse(d) for d in batch.slice(i, 64).column(0).to_pylist()]
                yield pa.RecordBatch.from_pylist([r for r in found if r], PARSED_ROW)

    return lines.mapInArrow(kernel, PARSED)


def reassemble(records: DataFrame) -> DataFrame:
    """Continuations joined to the record they continue; whole records pass without a shuffle."""
    whole = records.filter("segment is null").drop("segment", "origin", "total")
    parts = records.filter("segment is not null")
    first = F.col("segment") == 1
    own = ["row_id", "record_type", "record_id", "target", "refers_to", "payload_length", "digest"]
    joined = parts.groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in own],
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"), F.max("error").alias("error"))
    blocks = F.transform("parts", lambda p: p["block"])
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.octet_length(b))
    error = (F.when(F.col("error").isNotNull(), F.col("error")).when(~gapless, "segments are missing or repeated")
             .when(F.col("total").isNull() | (F.col("total") != length), "segments and total length differ"))
    segmented = joined.select(*own, blocks.alias("blocks"), error.alias("error"))
    kinds, names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema), whole.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a record at a time: each may be large
                part = batch.slice(i, 1)
                columns = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                block = b"".join(columns.pop("blocks")[0].as_py())  # one copy, however many segments
                columns["block"] = pa.array([block], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return whole.unionByName(segmented.mapInArrow(kernel, kinds))


def payloads(records: DataFrame) -> DataFrame:
    """Reassembled ``records`` with ``payload``: the HTTP body without chunk framing."""
    fields = [f for f in records.schema if f.name not in ("block", "error")]

    def decode(block: bytes | None) -> tuple[bytes | None, str | None]:
        if not block:
            return None, None
        head, _, body = block.partition(b"\r\n\r\n")
        if not re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head):
            return body, None
        try:
            return dechunked(body), None
        except ValueError as e:
            return None, str(e)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                blocks = part.column(part.schema.get_field_index("block")).to_pylist()
                errors = part.column(part.schema.get_field_index("error")).to_pylist()
                found = [(None, e) if e else decode(b) for b, e in zip(blocks, errors)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f.name)) for f in fields),
                     pa.array([p for p, _ in found], pa.binary()), pa.array([e for _, e in found], pa.string())],
                    [*(f.name for f in fields), "payload", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return records.mapInArrow(kernel, f"{kinds}, payload binary, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: ``row_id, record_type, record_id, target, refers_to,
    payload_length, digest, payload, error``. A continuation without a first segment is a row with ``error``."""
    return payloads(reassemble(read_records(spark, path)))
