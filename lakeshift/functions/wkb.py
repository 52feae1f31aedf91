"""Polygons as well-known binary, the geometry of GeoParquet files.

Decoding and encoding are Arrow-batched: one Python call per batch of rows.
Polygons and multi-polygons, either byte order, with or without Z and M
(dropped) and with an SRID (ignored). Other geometry types fail.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RINGS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
RINGS_DDL = "array<array<array<struct<x:double,y:double>>>>"


def decode(data: bytes) -> list:
    """Polygons -> rings -> vertices ``{x, y}``."""
    at = 0

    def polygon_or_parts() -> list:
        nonlocal at
        order = "<" if data[at] else ">"
        kind, = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        if kind & 0x20000000:
            at += 4
        kind &= 0x1FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
        count, = struct.unpack_from(f"{order}I", data, at)
        at += 4
        if kind % 1000 == 6:
            return [p for _ in range(count) for p in polygon_or_parts()]
        if kind % 1000 != 3:
            raise ValueError(f"geometry type {kind} is no polygon")
        rings = []
        for _ in range(count):
            n, = struct.unpack_from(f"{order}I", data, at)
            xy = np.frombuffer(data, f"{order}f8", n * dims, at + 4).reshape(n, dims)[:, :2]
            at += 4 + 8 * n * dims
            rings.append([{"x": x, "y": y} for x, y in xy.tolist()])
        return [rings]

    return polygon_or_parts()


def encode(rings: list) -> bytes:
    """A little-endian polygon, or multi-polygon where there are several."""
    def polygon(part: list) -> bytes:
        body = [struct.pack("<BII", 1, 3, len(part))]
        for ring in part:
            xy = np.array([(v["x"], v["y"]) for v in ring], "<f8")
            body += [struct.pack("<I", len(ring)), xy.tobytes()]
        return b"".join(body)

    if len(rings) == 1:
        return polygon(rings[0])
    return struct.pack("<BII", 1, 6, len(rings)) + b"".join(map(polygon, rings))


def _mapped(df: DataFrame, source: str, target: str, fn, kind: pa.DataType, ddl: str) -> DataFrame:
    from ..session import ship_package
    ship_package(df.sparkSession)
    at = df.columns.index(source)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if v is None else fn(v) for v in batch.column(at).to_pylist()], kind)
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made],
                                             [*(batch.schema.names[i] for i in keep), target])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != source]
    return df.mapInArrow(kernel, ", ".join([*fields, f"`{target}` {ddl}"]))


def wkb_to_rings(df: DataFrame, column: str = "geometry") -> DataFrame:
    """``df`` with ``rings`` in place of the binary ``column``."""
    return _mapped(df, column, "rings", decode, RINGS, RINGS_DDL)


def rings_to_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """``df`` with the binary ``column`` in place of ``rings``."""
    return _mapped(df, "rings", column, encode, pa.binary(), "binary")
