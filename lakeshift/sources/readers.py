"""Readers: water panels, lake polygons, result files and date lists.

Everything is ``spark.read``; Hadoop file systems cover remote paths
(``s3a://``, ``gs://``, ``abfs://``) the same way as local ones.
"""

from __future__ import annotations

import datetime as dt
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType,
                               ShortType, StringType, StructField, StructType, TimestampType)

from ..family import DATE, ID, Family, detect_family
from ..functions.wkb import wkb_to_rings
from ..operators.geo import BOX, filter_bbox
from ..operators.panel import clean_nan
from .footers import parquet_footers

REMOTE_SCHEMES = ("s3://", "s3a://", "gs://", "gcs://", "abfs://", "abfss://", "http://", "https://", "hdfs://")


def is_remote_path(path: str) -> bool:
    return str(path).startswith(REMOTE_SCHEMES)


def _reader_format(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    p = str(path).split("?")[0].lower()
    for suffix, f in ((".csv", "csv"), (".json", "json"), (".geojson", "json"), (".ndjson", "json"),
                      (".geojsonl", "json"), (".orc", "orc")):
        if p.endswith(suffix):
            return f
    return "parquet"


def read_panel(spark: SparkSession, path: str, family: Family | None = None, fmt: str | None = None,
               date_col: str = DATE, **options) -> DataFrame:
    """Load a long water panel (S1): NaN -> NULL once, date typed, family checked."""
    f = _reader_format(path, fmt)
    reader = spark.read.options(**options)
    if f == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    df = reader.format(f).load(path)
    if date_col != DATE:
        df = df.withColumnRenamed(date_col, DATE)
    family = family or detect_family(df)
    df = df.withColumn(DATE, F.to_date(F.col(DATE)))
    if "area_nodata" in df.columns and family.name == "jrc":
        df = df.drop("area_nodata")  # recomputed by prepare
    return clean_nan(df.filter(F.col(ID).isNotNull()), family)


def read_lakes(spark: SparkSession, path: str, fmt: str | None = None, order_by_area: bool = False,
               bbox: dict | None = None) -> DataFrame:
    """Lake polygons (S3): Parquet with ``rings`` or WKB ``geometry``, GeoJSON lines or collections.

    Rows with NULL or empty geometry are dropped, largest first on request; a
    polygon that cannot be parsed fails the job. ``bbox`` (west, south, east,
    north, each optional) keeps the lakes whose centroid lies in it; of a
    table that ``write_lakes`` wrote only the row groups near it are read,
    and its box columns are not part of the result.
    """
    f = _reader_format(path, fmt)
    if f == "json":
        df = read_geojson(spark, path)
    else:
        df = spark.read.format(f).load(path)
        if "rings" not in df.columns and dict(df.dtypes).get("geometry") == "binary":
            df = wkb_to_rings(df)
    df = df.filter(F.col("rings").isNotNull() & (F.size(F.flatten(F.flatten("rings"))) > 0))
    if bbox:
        df = filter_bbox(df, **bbox).drop(*BOX)
    if order_by_area and "Area_start_ha" in df.columns:
        df = df.orderBy(F.desc("Area_start_ha"))
    return df


#: What stands in front of each feature's other members, in files that give a feature's type first.
MARK = '"Feature"'


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON lines, or of FeatureCollections on any number of lines.

    Collections are first split into lines by many tasks (``feature_lines``);
    one whose features do not give their type first, or that holds the text
    ``"Feature"`` elsewhere, is read as a whole by one task a file. Only the
    properties' types are inferred. Coordinates are read as JSON text, whose
    nesting then depends on each feature's own geometry type.
    """
    head = spark.read.option("lineSep", MARK).text(path).head(1)
    if not head or '"FeatureCollection"' not in head[0].value:
        return geojson_features_to_lakes(features_of(spark, path, spark.read.json(path).schema))
    lines = feature_lines(spark, path)
    if lines is not None:
        return geojson_features_to_lakes(features_of(spark, lines, spark.read.json(lines).schema))
    inner = spark.read.option("multiLine", "true").json(path).schema["features"].dataType.elementType
    whole = StructType([StructField("features", ArrayType(feature_type(inner)))])
    found = (spark.read.schema(whole).option("multiLine", "true").option("mode", "FAILFAST").json(path)
             .select(F.explode("features").alias("f")).select("f.*"))
    return geojson_features_to_lakes(found)


def feature_type(schema: StructType) -> StructType:
    return StructType([StructField("properties", schema["properties"].dataType),
                       StructField("geometry", StructType([StructField("type", StringType()),
                                                           StructField("coordinates", StringType())]))])


def features_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(feature_type(schema)).option("mode", "FAILFAST").json(path)


def feature_lines(spark: SparkSession, path: str) -> str | None:
    """The features of the collections under ``path`` as GeoJSON lines: the path of a copy in the shared folder.

    Spark's text reader cuts the files at ``"Feature"``, in byte ranges over
    many tasks. What follows it, up to the end of the object it stands in, is
    the feature. None if a piece is no whole feature with a geometry.
    """
    import json

    import pyarrow as pa
    from ..session import checkpoint_dir

    def kernel(batches):
        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for text in batch.column(0):
                whole = '{"type":"Feature"' + text.as_py()
                try:
                    found, end = decoder.raw_decode(whole)
                except ValueError:
                    out.append(None)
                    continue
                # line ends inside strings are escaped, so these stand between tokens
                out.append(" ".join(whole[:end].splitlines()) if {"geometry", "properties"} <= found.keys() else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    pieces = spark.read.option("lineSep", MARK).text(path)
    # the piece before the first feature of a file opens the collection; the others go on after the mark
    head = F.ltrim("value").startswith("{") & F.col("value").contains('"FeatureCollection"')
    lines = f"{checkpoint_dir(spark).rstrip('/')}/tables/features-{uuid.uuid4().hex}"
    pieces.filter(~head).mapInArrow(kernel, "value string").fillna("").write.text(lines)
    broken = spark.read.text(lines).filter(F.col("value") == "").limit(1).count()
    return None if broken else lines


def geojson_features_to_lakes(features: DataFrame) -> DataFrame:
    """Feature rows (``geometry.coordinates`` as JSON text) -> properties and ``rings``."""
    # a polygon is ring -> vertex -> [x, y]; a multi-polygon adds a level
    poly_t, multi_t = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    multi = (F.when(kind == "MultiPolygon", F.from_json(text, multi_t))
             .when(kind == "Polygon", F.array(F.from_json(text, poly_t))))
    rings = F.transform(multi, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))))
    broken = F.col("geometry").isNotNull() & text.isNotNull() & F.coalesce(
        F.exists(rings, lambda p: p.isNull()), rings.isNull())
    checked = F.when(broken, F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce(kind, F.lit("?")), F.lit(" "),
                                                    F.substring(text, 1, 200)))).otherwise(rings)
    props = [F.col(f"properties.`{c}`").alias(c) for c in features.schema["properties"].dataType.names]
    return features.select(*props, checked.alias("rings"))


def read_lake(lakes_path_or_df, lake_id: str, spark: SparkSession | None = None) -> DataFrame:
    """One lake by id equality (S4); Parquet row-group statistics prune the read."""
    df = lakes_path_or_df if isinstance(lakes_path_or_df, DataFrame) else spark.read.parquet(lakes_path_or_df)
    return df.filter(F.col(ID) == F.lit(lake_id))


def read_lakes_in(lakes: DataFrame, ids: DataFrame) -> DataFrame:
    """Polygons of a set of ids (S5): semi join; AQE picks broadcast for a small id set."""
    return lakes.join(ids.select(ID).distinct(), ID, "left_semi")


def break_file_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What each result file below ``paths`` holds (S6): ``(path, n_rows, fields, id_field, problem)``.

    ``problem`` is NULL for the files that ``read_break_files`` takes.
    """
    problem = (F.when(F.col("error").isNotNull(), F.col("error"))
               .when(F.col("id_field").isNull(), F.lit(f"no column {ID}"))
               .when(F.col("n_rows") == 0, F.lit("no rows")))
    return parquet_footers(spark, paths).select("path", "n_rows", "fields", "id_field", problem.alias("problem"))


def read_break_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Merge result files (S6): union by name, types widened.

    One job reads the footers of all files in its tasks; files of one schema
    then make one scan, so thousands of files make a handful of scans. A
    column whose type differs between schemas takes the wider numeric type,
    or text. Files that are unreadable, without rows or without an id column
    (nor an index of that name) are reported and left out; none left is an
    error.
    """
    groups: dict[tuple, list[str]] = {}
    # one row per file that the caller lists
    for r in sorted(break_file_report(spark, paths).collect(), key=lambda r: r.path):
        if r.problem is not None:
            warnings.warn(f"{r.path} is left out: {r.problem}", stacklevel=2)
        else:
            groups.setdefault((r.fields, r.id_field), []).append(r.path)
    if not groups:
        raise FileNotFoundError(f"none of {len(paths)} paths has a file with rows and a column {ID}")
    kinds: dict[str, list] = {}
    scans = []
    for (_, id_field), files in groups.items():
        schema = spark.read.parquet(files[0]).schema
        scan = spark.read.schema(schema).parquet(*files)
        if id_field != ID:
            scan = scan.withColumnRenamed(id_field, ID)
        scans.append(scan)
        for f in scan.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    out = None
    for scan in scans:
        part = scan.select(*[F.col(f"`{c}`").cast(wider(kinds[c])).alias(c) for c in scan.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def wider(kinds: list) -> DataType:
    """The type that holds values of all ``kinds``."""
    distinct = list(dict.fromkeys(kinds))
    if len(distinct) == 1:
        return distinct[0]
    order = [ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType()]
    if all(k in order for k in distinct):
        top = max(distinct, key=order.index)
        # neither a long nor an int fits a float
        return DoubleType() if top == FloatType() and {IntegerType(), LongType()} & {*distinct} else top
    if {*distinct} == {DateType(), TimestampType()}:
        return TimestampType()
    return StringType()


def read_nrt_results(spark: SparkSession, path: str) -> DataFrame:
    """NRT results (S7): one file or a month-partitioned directory; the
    month is derived from ``date`` (or ``date_break``) when absent."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if "analysis_month" not in df.columns:
        src = [F.date_format(c, "yyyy-MM") for c in ("date", "date_break") if c in df.columns]
        df = df.withColumn("analysis_month", F.coalesce(*src) if src else F.lit(None).cast("string"))
    return df


def counts_of_results(results: DataFrame, confident: bool = False) -> DataFrame:
    """Lakes per month derived from result rows, where no counts table was written."""
    rows = results.filter(F.col("drainage_confidence") > 0) if confident else results
    return rows.groupBy("analysis_month").agg(F.countDistinct(ID).cast("int").alias("drained_lake_count"))


# --------------------------------------------------------------------------- date lists

def monthly_dates(spark: SparkSession, years, months) -> DataFrame:
    """First-of-month dates for every (year, month) pair."""
    ys = F.array(*[F.lit(int(y)) for y in years])
    ms = F.array(*[F.lit(int(m)) for m in months])
    g = spark.range(1).select(F.explode(ys).alias("y")).select("y", F.explode(ms).alias("m"))
    return g.select(F.make_date("y", "m", F.lit(1)).alias(DATE)).orderBy(DATE)


def only_one_way(given: dict, lists: tuple, parts: tuple) -> None:
    """Dates come from one list, or from all of ``parts``: anything else is refused before a job starts."""
    has = {name for name, value in given.items() if value is not None}
    if has & set(lists) and has & set(parts):
        raise ValueError(f"dates are named twice: by {', '.join(sorted(has))}")
    if not has & set(lists) and has != set(parts):
        raise ValueError(f"dates need {lists[0]}, or all of {', '.join(parts)}")


def dates_from_options(spark: SparkSession, years=None, months=None, date_list=None) -> DataFrame:
    """``date_list``, or every pair of ``years`` and ``months``."""
    only_one_way({"date_list": date_list, "years": years, "months": months}, ("date_list",), ("years", "months"))
    if date_list is None:
        return monthly_dates(spark, years, months)
    if len(date_list) == 0:
        raise ValueError("an empty date_list names no date")
    return spark.createDataFrame([(str(d),) for d in date_list], "d string").select(F.to_date("d").alias(DATE))


def annual_dates(spark: SparkSession, years=None, date_list=None) -> DataFrame:
    """1 January of each year (default 2000..2021), or ``date_list`` instead."""
    if date_list is not None:
        return dates_from_options(spark, years=years, date_list=date_list)
    years = list(years) if years is not None else list(range(2000, 2022))
    return monthly_dates(spark, years, [1])


def stepped_dates(spark: SparkSession, start: str, step: int = 7, count: int | None = None,
                  end: str | None = None) -> DataFrame:
    """Every ``step`` days from ``start``: ``count`` dates or up to ``end``."""
    if count is None and end is None:
        raise ValueError("give count or end")
    s = dt.date.fromisoformat(start)
    e = dt.date.fromisoformat(end) if end is not None else s + dt.timedelta(days=step * (count - 1))
    seq = F.sequence(F.lit(s), F.lit(e), F.expr(f"interval {int(step)} days"))
    return spark.range(1).select(F.explode(seq).alias(DATE))
