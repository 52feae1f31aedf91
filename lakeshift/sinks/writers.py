"""Writers (K1-K5, K8): panels, breaks with geometry, month files, clustered
layouts and GeoJSON lines. All are DataFrame writes from the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampType

from ..family import DATE, ID, Family, detect_family
from ..functions.geometry import with_shape_columns
from ..functions.numeric import round_even
from ..operators.geo import lake_curve, with_box

# Property columns exported with each lake feature, per view.
DEFAULT_TILE_PROPERTIES = ("id_geohash", "Area_start_ha", "Area_end_ha", "NetChange_ha", "NetChange_perc")
DRAINAGE_YEAR_PROPERTIES = ("id_geohash", "date_break", "date_break_year", "pre_break_median",
                            "post_break_median", "water_change_ha", "water_change_perc")
NRT_DRAINAGE_PROPERTIES = ("id_geohash", "date", "water_observed_absolute", "water_predicted_absolute",
                           "water_predicted_ci_absolute", "water_residual_absolute", "drainage_confidence")
VIEW_PROPERTIES = {"lakes": DEFAULT_TILE_PROPERTIES, "drainage_year": DRAINAGE_YEAR_PROPERTIES,
                   "nrt_drainage": NRT_DRAINAGE_PROPERTIES}


def write_panel(df: DataFrame, path: str, partition_by_year: bool = True) -> None:
    """Save a panel, overwriting (K1); partitioned by year for date pruning.

    Rows are ranged by (year, id): each year is a few files of neighbouring
    lakes, whatever the number of tasks, and each file is sorted by lake and
    date (O3).
    """
    if partition_by_year:
        w = df.withColumn("year", F.year(DATE)).repartitionByRange("year", ID, DATE)
        w.sortWithinPartitions("year", ID, DATE).write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        w = df.repartitionByRange(ID, DATE)
        w.sortWithinPartitions(ID, DATE).write.mode("overwrite").parquet(path)


def write_breaks(breaks: DataFrame, lakes: DataFrame | None, path: str, geometry: bool = True,
                 all_lakes: bool = False) -> None:
    """Join geometry (left: every lake, inner: only lakes with a break) and save (K2)."""
    out = breaks
    if geometry and lakes is not None:
        out = lakes.join(breaks, ID, "left" if all_lakes else "inner")
    out.write.mode("overwrite").parquet(path)


def write_nrt_month(df: DataFrame, out_dir: str, months: list[str] | None = None) -> None:
    """Month files (K3): dynamic overwrite of the ``analysis_month`` partitions
    present in ``df``; rows sorted by id inside each file.

    With ``months``, each of them without a row in ``df`` gets a file without
    rows, which replaces what an earlier run left there. Rows are ranged by
    (month, id): a busy month is split over tasks, a quiet one is one file.
    """
    (df.repartitionByRange("analysis_month", ID).sortWithinPartitions("analysis_month", ID)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("analysis_month").parquet(out_dir))
    if months:
        # the months of a range: twelve a year
        found = {r[0] for r in df.select("analysis_month").distinct().collect()}
        empty = df.sparkSession.createDataFrame([], df.drop("analysis_month").schema).coalesce(1)
        for month in sorted(set(months) - found):
            empty.write.mode("overwrite").parquet(f"{out_dir}/analysis_month={month}")


def cluster_by_key(df: DataFrame, out_path: str, key: str = ID, rows_per_group: int = 2000,
                   in_path: str | None = None, n_files: int | None = None) -> None:
    """Rewrite sorted by ``key`` with small row groups (K4), so that an equality
    lookup on the key reads about one row group.

    Range partitioning keeps every file a disjoint key range; no single task
    sorts the whole table. Row groups carry their range, pages a column
    index, and a Bloom filter of the key for ids that are not there.
    """
    if in_path is not None and in_path.rstrip("/") == out_path.rstrip("/"):
        raise ValueError("a table cannot be clustered onto itself: choose another output path")
    if key not in df.columns:
        raise ValueError(f"there is no column {key!r} to cluster by; the table has {', '.join(df.columns)}")
    n = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (small_groups(df.repartitionByRange(n, key).sortWithinPartitions(key).write, rows_per_group)
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_group)).parquet(out_path))


def small_groups(writer, rows_per_group: int):
    """An overwriting Parquet writer with row groups of at most ``rows_per_group`` rows."""
    return (writer.mode("overwrite").option("parquet.block.row.count.limit", str(rows_per_group))
            .option("parquet.page.row.count.limit", str(min(rows_per_group, 20000))))


def write_lakes(lakes: DataFrame, path: str, rows_per_group: int = 2000, n_files: int | None = None) -> None:
    """Lakes with box columns, clustered along a curve over the poles' projections.

    Neighbours share row groups, so the groups' box ranges are narrow and a
    reader with a bounding box skips the others (``read_lakes(bbox=...)``).
    """
    n = n_files or int(lakes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxed = with_box(lakes)
    at = lake_curve((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2)
    placed = boxed.withColumn("_curve", at).repartitionByRange(n, "_curve", ID).sortWithinPartitions("_curve", ID)
    small_groups(placed.drop("_curve").write, rows_per_group).parquet(path)


def _property(c: str, dtype) -> Column:
    col = F.col(c)
    if isinstance(dtype, (DoubleType, FloatType)):
        return F.when(F.isnan(col), F.lit(None)).otherwise(round_even(col, 2))
    if isinstance(dtype, (DateType, TimestampType)):
        return col.cast("string")
    return col


def geojson_lines(lakes: DataFrame, props=DEFAULT_TILE_PROPERTIES, points: bool = False) -> DataFrame:
    """One GeoJSON Feature per line (K5, M9): polygons, or centroid points.

    Numbers rounded to 2 places, dates as text, missing values as null.
    """
    types = dict((f.name, f.dataType) for f in lakes.schema.fields)
    keep = [c for c in props if c in types]
    valid = lakes.filter(F.col("rings").isNotNull() & (F.size(F.flatten(F.flatten("rings"))) > 0))
    properties = F.struct(*[_property(c, types[c]).alias(c) for c in keep])
    if points:
        valid = with_shape_columns(valid)
        geom = F.struct(F.lit("Point").alias("type"), F.array(F.col("cx"), F.col("cy")).alias("coordinates"))
    else:
        coords = F.transform("rings", lambda poly: F.transform(
            poly, lambda ring: F.transform(ring, lambda v: F.array(v["x"], v["y"]))))
        geom = F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
    feat = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geom.alias("geometry"))
    return valid.select(F.to_json(feat, {"ignoreNullFields": "false"}).alias("value"))


def write_geojsonseq(lakes: DataFrame, path: str, props=DEFAULT_TILE_PROPERTIES, points: bool = True,
                     view: str | None = None) -> None:
    """Polygon features, and centroid points next to them; ``view`` picks a
    property preset (``lakes``, ``drainage_year``, ``nrt_drainage``)."""
    props = VIEW_PROPERTIES[view] if view else props
    geojson_lines(lakes, props).write.mode("overwrite").text(path)
    if points:
        geojson_lines(lakes, props, points=True).write.mode("overwrite").text(path.rstrip("/") + "_points")


# Units and descriptions attached to panel variables (K8).
DESCRIPTIONS = {
    "area_data": "area with valid land-cover data",
    "area_nodata": "area without data (maximum area minus area with data)",
    "area_land": "land area",
    "area_water_seasonal": "seasonal water area",
    "area_water_permanent": "permanent water area",
}


def describe_columns(df: DataFrame, family: Family | None = None, unit: str = "ha") -> DataFrame:
    """Attach ``unit`` and ``description`` metadata to the variables (K8)."""
    family = family or detect_family(df)
    cols = []
    for c in df.columns:
        if c in family.classes or c in ("area_data", "area_nodata"):
            meta = {"unit": unit, "description": DESCRIPTIONS.get(c, f"{c.replace('_', ' ')} area"),
                    "family": family.name}
            cols.append(F.col(c).alias(c, metadata=meta))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
