"""Parquet footers read by the executors, as a table with one row per file.

Paths are listed by Spark (one job for any number of them) and become rows;
each task opens its files and reads their footers alone. File systems that
the Arrow reader does not know give their bytes through Spark instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..family import ID
from ..session import ship_package

#: Schemes of Spark paths and the Arrow file system that serves them.
ARROW_SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}

FOOTER = ("path string, n_rows long, fields string, id_field string, "
          "row_groups array<struct<n_rows: long, lo: string, hi: string>>, error string")
GROUP_TYPE = pa.list_(pa.struct([("n_rows", pa.int64()), ("lo", pa.string()), ("hi", pa.string())]))


def scheme_of(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else ""


def opened(path: str, content: bytes | None):
    """The file for Arrow's Parquet reader."""
    if content is not None:
        return pa.BufferReader(content)
    from pyarrow import fs
    from urllib.parse import quote
    scheme, rest = scheme_of(path), path.partition(":")[2] if scheme_of(path) else path
    if ARROW_SCHEMES[scheme] == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}:{quote(rest, safe='/:@?=&,')}")
    return system.open_input_file(inner)


def id_field_of(schema: pa.Schema) -> str | None:
    """The field that holds the lake ids: by name, or by the name that pandas noted for an index."""
    if ID in schema.names:
        return ID
    notes = json.loads((schema.metadata or {}).get(b"pandas", b"{}"))
    for column in notes.get("columns", []):
        if column.get("name") == ID and column.get("field_name") in schema.names:
            return column["field_name"]
    return None


def footer_of(path: str, content: bytes | None, key: str | None) -> dict:
    import pyarrow.parquet as pq
    with opened(path, content) as source:
        meta = pq.ParquetFile(source).metadata
    schema = meta.schema.to_arrow_schema()
    at = next((i for i in range(len(meta.schema)) if meta.schema.column(i).path == key), None)
    groups = []
    for i in range(meta.num_row_groups):
        group = meta.row_group(i)
        stats = group.column(at).statistics if at is not None else None
        known = stats is not None and stats.has_min_max
        groups.append({"n_rows": group.num_rows, "lo": str(stats.min) if known else None,
                       "hi": str(stats.max) if known else None})
    return {"path": path, "n_rows": meta.num_rows, "fields": schema.remove_metadata().to_string(),
            "id_field": id_field_of(schema), "row_groups": groups, "error": None}


def list_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """``(path, content)`` rows of all files below ``paths``, and the paths that do not exist.

    The content is only ever read if a query asks for that column.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return reader.load(paths), []
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)
    found = [p for p in paths if exists(p)]
    missing = [p for p in paths if p not in set(found)]
    return (reader.load(found) if found else spark.createDataFrame([], "path string, content binary")), missing


def parquet_footers(spark: SparkSession, paths: list[str], key: str | None = None) -> DataFrame:
    """One row per Parquet file below ``paths``: rows, fields, id field, row groups with the range of ``key``.

    Files that cannot be read, and paths that do not exist, have an ``error``.
    """
    ship_package(spark)
    files, missing = list_files(spark, paths)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(~name.startswith("_") & ~name.startswith("."))
    through_spark = any(scheme_of(p) not in ARROW_SCHEMES for p in paths)
    content = F.col("content") if through_spark else F.lit(None).cast("binary").alias("content")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows.append(footer_of(path, data.as_py(), key))
                except (OSError, ValueError, KeyError, pa.ArrowException) as exc:
                    rows.append({"path": path, "error": str(exc).splitlines()[0] if str(exc) else type(exc).__name__})
            names = ["path", "n_rows", "fields", "id_field", "row_groups", "error"]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), GROUP_TYPE, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    out = files.select("path", content).mapInArrow(kernel, FOOTER)
    if missing:
        lost = spark.createDataFrame([(p,) for p in missing], "path string")
        out = out.unionByName(lost.withColumn("error", F.lit("no such path")), allowMissingColumns=True)
    return out


def row_groups_holding(footers: DataFrame, ids: list[str]) -> DataFrame:
    """``(key, n_groups)``: how many row groups a reader of each of a few ``ids`` cannot rule out by their ranges."""
    groups = footers.select(F.explode("row_groups").alias("g"))
    holds = [F.count_if(F.coalesce(F.lit(i).between(F.col("g.lo"), F.col("g.hi")), F.lit(True))) for i in ids]
    counts = groups.agg(*[h.alias(f"n{k}") for k, h in enumerate(holds)])
    pairs = F.array(*[F.struct(F.lit(i).alias("key"), F.col(f"n{k}").alias("n_groups")) for k, i in enumerate(ids)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")
