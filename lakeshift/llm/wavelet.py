"""Token ids in wavelet-matrix files.

A shard holds the ids of whole documents, in order, as one wavelet matrix:
one bit-plane per bit of an id, highest first; after each plane the ids with
bit 0 move, in order, before those with bit 1. Planes are stored in
compressed blocks with the number of ones before each block, so that

* ``access(i)`` (the id at a place),
* ``count(id, start, stop)`` (occurrences in a range) and
* ``positions(id)`` (places of an id, by selecting upwards)

read one or two blocks a plane from the file, and a whole shard decodes plane
by plane without random access. Layout, little-endian: magic, length of the
JSON header, header, blocks. The header has the number of ids, bits, zeros
per plane, offsets of blocks and of the document table (ids' bytes, starts).

Documents are range-partitioned by id; each task writes shards of bounded
size through the filesystem of the shared folder, under names of its own
attempt, and returns one row per shard. Only files named in rows of
successful tasks are ever read, so a lost executor costs its tasks alone.

Null text counts as empty (the end id alone); repeated rows are documents of
their own, ordered by id, then text hash; NULL ids come first; an empty
table gives no files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lakeshift.llm.common import spread, stored
from lakeshift.llm.tokens import encoder
from lakeshift.session import ship_package

MAGIC = b"LSWM0001"
BLOCK = 1 << 17  # bits
RUN = 1 << 16  # bits moved at once
#: Schemes of Spark paths that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
SHARD_ROW = pa.schema([("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def arrow_uri(path: str) -> str:
    """A path as Spark names it, as Arrow does."""
    scheme, colon, rest = path.partition(":")
    return f"{SCHEMES[scheme]}:{rest}" if colon and scheme in SCHEMES else path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path, and the path inside it."""
    return pafs.FileSystem.from_uri(arrow_uri(path))


def packed_keys(keys: list, kind: pa.DataType) -> list | bytes:
    """Ids for ``dump``: JSON holds whole numbers and texts, Arrow's stream format all other types."""
    if pa.types.is_integer(kind) or pa.types.is_string(kind):
        return keys
    sink = pa.BufferOutputStream()
    table = pa.table({"id": pa.array(keys, kind)})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def sides(bit: np.ndarray, zeros: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Where the two values of a plane's bits go: places of one value in a run from ``first``, and where they start.

    Places are found by run, so that they stay in the cache; a mask of random bits costs several times as much.
    """
    to = [0, zeros]
    for first in range(0, len(bit), RUN):
        run = bit[first: first + RUN]
        for side, places in enumerate((np.flatnonzero(~run), np.flatnonzero(run))):
            yield first, places, to[side]
            to[side] += len(places)


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes (packed) and zeros per plane of ``ids``."""
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out, planes, zeros = np.empty_like(seq), [], []
    for b in reversed(range(bits)):
        bit = (seq & seq.dtype.type(1 << b)) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        zeros.append(len(bit) - int(np.count_nonzero(bit)))
        if b:
            for first, places, to in sides(bit, zeros[-1]):
                # places are in range; the default mode would copy ``out``
                seq[first: first + RUN].take(places, out=out[to: to + len(places)], mode="clip")
            seq, out = out, seq
    return planes, zeros


def restore(planes: list[np.ndarray], zeros: list[int], n: int) -> np.ndarray:
    """The ids, from the last plane up."""
    seq = np.zeros(n, np.uint16 if len(planes) <= 16 else np.uint32)
    out = np.empty_like(seq)
    for level in reversed(range(len(planes))):
        bit = np.unpackbits(planes[level], count=n, bitorder="little").view(bool)
        seq[zeros[level]:] |= seq.dtype.type(1 << (len(planes) - 1 - level))
        for first, places, to in sides(bit, zeros[level]):
            out[first: first + RUN][places] = seq[to: to + len(places)]
        seq, out = out, seq
    return seq


def dump(ids: np.ndarray, doc_keys: list | bytes, starts: np.ndarray, bits: int) -> bytes:
    """One shard file. ``starts`` has one more entry than documents."""
    planes, zeros = build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    body, at = [], 0

    def add(data: bytes) -> list[int]:
        nonlocal at
        packed = pack(data)
        body.append(packed)
        at += len(packed)
        return [at - len(packed), len(packed)]

    levels = []
    for plane, z in zip(planes, zeros):
        parts = [plane[i: i + BLOCK // 8] for i in range(0, len(plane), BLOCK // 8)]
        ones = np.cumsum([0, *(int(np.bitwise_count(p).sum(dtype=np.int64)) for p in parts)]).tolist()
        levels.append({"zeros": z, "ones": ones, "blocks": [add(p.tobytes()) for p in parts]})
    head = {"n": len(ids), "bits": bits, "levels": levels, "arrow_keys": isinstance(doc_keys, bytes),
            "keys": add(doc_keys if isinstance(doc_keys, bytes) else json.dumps(doc_keys).encode()),
            "starts": add(np.asarray(starts, "<i8").tobytes())}
    header = zlib.compress(json.dumps(head).encode(), 1)
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


class Shard:
    """A shard file. ``read(offset, length)`` returns bytes of it."""

    def __init__(self, read):
        magic, size = struct.unpack("<8sI", read(0, 12))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        head = json.loads(zlib.decompress(read(12, size)))
        self.read, self.base = read, 12 + size
        self.n, self.bits, self.levels = head["n"], head["bits"], head["levels"]
        self.unpack = zstandard.ZstdDecompressor().decompress
        keys = self.section(head["keys"])
        self.keys = (pa.ipc.open_stream(keys).read_all()["id"].to_pylist() if head.get("arrow_keys")
                     else json.loads(keys))
        self.starts = np.frombuffer(self.section(head["starts"]), "<i8")

    @classmethod
    def open(cls, path: str) -> Shard:
        fs, name = file_system(path)
        file = fs.open_input_file(name)
        return cls(lambda at, size: file.read_at(size, at))

    def section(self, place: list[int]) -> bytes:
        return self.unpack(self.read(self.base + place[0], place[1]))

    def block(self, level: int, k: int) -> np.ndarray:
        return np.frombuffer(self.section(self.levels[level]["blocks"][k]), np.uint8)

    def ids(self) -> np.ndarray:
        """All ids."""
        if not self.n:
            return np.zeros(0, np.uint16)
        planes = [np.concatenate([self.block(i, k) for k in range(len(level["blocks"]))])
                  for i, level in enumerate(self.levels)]
        return restore(planes, [level["zeros"] for level in self.levels], self.n)

    def bit(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK)
        return int(self.block(level, k)[r >> 3] >> (r & 7) & 1)

    def rank(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        k, r = divmod(i, BLOCK)
        ones = self.levels[level]["ones"][k]
        if r:
            bits = np.unpackbits(self.block(level, k), count=r, bitorder="little")
            ones += int(bits.sum(dtype=np.int64))
        return ones

    def select(self, level: int, k: int, bit: int) -> int:
        """Place of the ``k``-th (from 0) ``bit`` of a plane."""
        ones = np.asarray(self.levels[level]["ones"])
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        size = min(BLOCK, self.n - block * BLOCK)
        bits = np.unpackbits(self.block(level, block), count=size, bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self.bit(level, i), self.rank(level, i)
            value = 2 * value + bit
            i = self.levels[level]["zeros"] + ones if bit else i - ones
        return value

    def interval(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where ``token``'s occurrences in [start, stop) end up below the last plane."""
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            lo, hi = self.rank(level, start), self.rank(level, stop)
            if token >> (self.bits - 1 - level) & 1:
                start, stop = self.levels[level]["zeros"] + lo, self.levels[level]["zeros"] + hi
            else:
                start, stop = start - lo, stop - hi
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        lo, hi = self.interval(token, start, self.n if stop is None else stop)
        return hi - lo

    def positions(self, token: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Places of ``token``, ascending."""
        found = []
        for i in range(*self.interval(token, start, self.n if stop is None else stop)):
            for level in reversed(range(self.bits)):
                bit = token >> (self.bits - 1 - level) & 1
                i = self.select(level, i - self.levels[level]["zeros"] if bit else i, bit)
            found.append(i)
        return found


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_ids: int = 1 << 21,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; one row ``(part, seq, path, n_docs, n_ids)`` per file, in document order.

    A shard ends with the document that takes it to ``shard_ids`` ids or more.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).repartitionByRange("id", "h")
    ordered = ordered.sortWithinPartitions("id", "h")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        bits = max(1, (max(encode.tokenizer.get_vocab_size(), end_id + 1) - 1).bit_length())
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        keys, blobs, sizes, held, seq, kind = [], [], [], 0, 0, pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal keys, blobs, sizes, held, seq
            ids = np.frombuffer(b"".join(blobs), "<u4")
            name = f"{uuid.uuid4().hex}.wm"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(dump(ids, packed_keys(keys, kind), np.cumsum([0, *sizes]), bits))
            row = pa.RecordBatch.from_pylist(
                [{"seq": seq, "path": f"{folder}/{name}", "n_docs": len(keys), "n_ids": len(ids)}], SHARD_ROW)
            keys, blobs, sizes, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                blob = encode.ids(text.as_py()) + end
                keys.append(key)
                blobs.append(blob)
                sizes.append(len(blob) // 4)
                held += sizes[-1]
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    written = ordered.mapInArrow(kernel, "seq int, path string, n_docs long, n_ids long")
    return stored(written.withColumn("part", F.spark_partition_id()), "shards")


def read_shards(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """Per document of the files: ``id, start, n_tokens, ids_crc32``; ``start`` counts the ids of all before it.

    ``id_type`` is the SQL type that the ids were written with.
    """
    ship_package(shards.sparkSession)
    key_type = to_arrow_type(StructType.fromDDL(f"id {id_type}")["id"].dataType)
    # ids before each shard: within its part, plus those of the parts before (one row per task that wrote)
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    based = (shards.withColumn("inner", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
             .join(offsets, "part").select("path", (F.col("inner") + F.col("part_base")).alias("base")))
    # a shard is work for seconds: they are spread over as many tasks as a shuffle has, and not put together again
    based = spread(stored(based, "offsets"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.open(row["path"])
                ids, starts = memoryview(shard.ids().astype("<u4")).cast("B"), shard.starts
                crc = [zlib.crc32(ids[4 * a: 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys, key_type), pa.array(starts[:-1] + row["base"]),
                     pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(kernel, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
