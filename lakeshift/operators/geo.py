"""Lake polygon operations.

Polygons are ``rings ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>``; every spatial test
is a higher-order SQL expression, joins use equality keys (id, grid cell).
Points are matched to lakes in ``covering.py``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..family import ID
from ..functions.geometry import bounds, box_of, contains, polar_xy, vertices, with_shape_columns


def with_centroid(lakes: DataFrame) -> DataFrame:
    """Add ``cx, cy, area_deg2`` (vectorised Arrow kernel, computed once per row)."""
    return with_shape_columns(lakes)


def check_bbox(west=None, south=None, east=None, north=None) -> None:
    if all(v is None for v in (west, south, east, north)):
        raise ValueError("At least one bounding box coordinate must be given")
    if west is not None and east is not None and west > east:
        raise ValueError("bbox_west must be <= bbox_east")
    if south is not None and north is not None and south > north:
        raise ValueError("bbox_south must be <= bbox_north")


#: Box columns that the writers add to lakes; Parquet keeps their range per row group.
BOX = ("minx", "miny", "maxx", "maxy")


def with_box(lakes: DataFrame) -> DataFrame:
    """``lakes`` with the box of each polygon as columns, unless it has them."""
    if set(BOX) <= set(lakes.columns):
        return lakes
    boxed = lakes.withColumn("_box", box_of(F.col("rings")))
    return boxed.select(*lakes.columns, *[F.col("_box")[c].alias(c) for c in BOX])


def box_meets(west=None, south=None, east=None, north=None) -> Column:
    """Whether a lake's box meets the given one: plain comparisons of columns, which Parquet prunes by."""
    tests = [(F.col("maxx") >= F.lit(float(west))) if west is not None else None,
             (F.col("minx") <= F.lit(float(east))) if east is not None else None,
             (F.col("maxy") >= F.lit(float(south))) if south is not None else None,
             (F.col("miny") <= F.lit(float(north))) if north is not None else None]
    cond = F.lit(True)
    for t in tests:
        cond = cond if t is None else cond & t
    return cond


def filter_bbox(lakes: DataFrame, west=None, south=None, east=None, north=None) -> DataFrame:
    """Lakes whose centroid lies in the box, bounds inclusive, each optional (F1).

    A centroid lies inside its polygon's box, so where the lakes have box
    columns those outside are passed over first: by row groups in the scan
    of a table that ``write_lakes`` clustered, row by row otherwise. The
    exact test reads the polygons of the rest.
    """
    check_bbox(west, south, east, north)
    if set(BOX) <= set(lakes.columns):
        lakes = lakes.filter(box_meets(west, south, east, north))
    cx, cy = F.col("cx"), F.col("cy")
    cond = F.lit(True)
    if west is not None:
        cond = cond & (cx >= F.lit(float(west)))
    if east is not None:
        cond = cond & (cx <= F.lit(float(east)))
    if south is not None:
        cond = cond & (cy >= F.lit(float(south)))
    if north is not None:
        cond = cond & (cy <= F.lit(float(north)))
    return with_shape_columns(lakes).filter(cond).drop("cx", "cy", "area_deg2")


def filter_panel_by_bbox(panel: DataFrame, lakes: DataFrame, **bbox) -> DataFrame:
    """Panel rows of lakes present in both tables and inside the box (F2).

    A semi join on id: AQE broadcasts the id list when it is small and
    shuffles otherwise; no size is assumed.
    """
    inside = filter_bbox(lakes, **bbox).select(ID)
    return panel.join(inside, ID, "left_semi")


def filter_valid_geometry(lakes: DataFrame) -> DataFrame:
    """Non-NULL, non-empty polygons."""
    return lakes.filter(F.col("rings").isNotNull() & (F.size(vertices(F.col("rings"))) > 0))


def lake_bounds(lakes: DataFrame) -> DataFrame:
    """Per-lake ``minx, miny, maxx, maxy``."""
    b = bounds(F.col("rings"))
    return lakes.select(ID, b["minx"].alias("minx"), b["miny"].alias("miny"),
                        b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


def total_bounds(lakes: DataFrame) -> DataFrame:
    """Bounds over all lakes and their centre (G7): one partial/final aggregate."""
    b = lake_bounds(lakes)
    agg = b.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return (agg.withColumn("center_x", (F.col("minx") + F.col("maxx")) / 2)
               .withColumn("center_y", (F.col("miny") + F.col("maxy")) / 2))


def bbox_area_km2(lakes: DataFrame) -> DataFrame:
    """Area of the total bounding box after projecting to EPSG:3995."""
    pts = lakes.select(F.explode(vertices(F.col("rings"))).alias("p"))
    xy = pts.select(polar_xy(F.col("p.x"), F.col("p.y")).alias("q"))
    agg = xy.agg(F.min("q.x").alias("minx"), F.max("q.x").alias("maxx"),
                 F.min("q.y").alias("miny"), F.max("q.y").alias("maxy"))
    return agg.select(((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) / F.lit(1e6))
                      .alias("bbox_area_km2"))


def attach_geometry(breaks: DataFrame, lakes: DataFrame, how: str = "left") -> DataFrame:
    """Join results to polygons (J1/J6): ``left`` keeps every lake, ``inner`` only lakes with a result."""
    return lakes.join(breaks, ID, how)


def assign_grid_cell(lakes: DataFrame, dlon: float = 10.0, dlat: float = 2.0,
                     lon0: float = -180.0, lat0: float = 60.0) -> DataFrame:
    """Grid cell of each centroid by arithmetic (J10): half-open cells, no range join."""
    gx = F.floor((F.col("cx") - F.lit(lon0)) / F.lit(dlon))
    gy = F.floor((F.col("cy") - F.lit(lat0)) / F.lit(dlat))
    return (with_shape_columns(lakes)
            .withColumn("cell_lon", F.lit(lon0) + gx * F.lit(dlon))
            .withColumn("cell_lat", F.lit(lat0) + gy * F.lit(dlat))
            .drop("cx", "cy", "area_deg2"))


def grid_counts(lakes: DataFrame, dlon: float = 10.0, dlat: float = 2.0, lon0: float = -180.0,
                lat0: float = 60.0) -> DataFrame:
    cells = assign_grid_cell(lakes, dlon, dlat, lon0, lat0)
    return cells.groupBy("cell_lon", "cell_lat").agg(F.count(F.lit(1)).alias("n_lakes"))


def lonlat_grid(spark, lon_range=(-180.0, 180.0), lat_range=(60.0, 80.0), dlon=10.0, dlat=2.0) -> DataFrame:
    """Distinct lower-left corners, upper end excluded."""
    nx = max(0, math.ceil((lon_range[1] - lon_range[0]) / dlon))
    ny = max(0, math.ceil((lat_range[1] - lat_range[0]) / dlat))
    xs = F.transform(F.sequence(F.lit(0), F.lit(max(nx - 1, 0))), lambda i: F.lit(lon_range[0]) + i * F.lit(dlon))
    ys = F.transform(F.sequence(F.lit(0), F.lit(max(ny - 1, 0))), lambda i: F.lit(lat_range[0]) + i * F.lit(dlat))
    g = spark.range(1).select(F.explode(xs).alias("lon")).select("lon", F.explode(ys).alias("lat"))
    g = g.filter((F.col("lon") < F.lit(lon_range[1])) & (F.col("lat") < F.lit(lat_range[1])))
    return g.distinct() if nx and ny else g.limit(0)


def _geohash_text(lat: float, lon: float, precision: int) -> str:
    """Driver-side geohash of one literal point (used to build pushed-down filters)."""
    from ..functions.geohash import ALPHABET
    lo = [-90.0, 90.0], [-180.0, 180.0]
    bits, out, even = [], [], True
    while len(out) < precision:
        rng, v = (lo[1], lon) if even else (lo[0], lat)
        mid = (rng[0] + rng[1]) / 2
        if v >= mid:
            bits.append(1)
            rng[0] = mid
        else:
            bits.append(0)
            rng[1] = mid
        even = not even
        if len(bits) == 5:
            out.append(ALPHABET[int("".join(map(str, bits)), 2)])
            bits = []
    return "".join(out)


def lake_at_point(lakes: DataFrame, lat: float, lon: float) -> DataFrame:
    """Single click lookup (S4 + J8): id range filters per neighbour cell,
    which Parquet row-group statistics prune, then the exact test."""
    w, h = 360.0 / 1024, 180.0 / 1024  # precision-4 cell
    qlon, qlat = math.floor((lon + 180.0) / w), math.floor((lat + 90.0) / h)
    cells = set()
    for dj in (-1, 0, 1):
        for di in (-1, 0, 1):
            c_lon = (qlon + di) % 1024
            c_lat = min(max(qlat + dj, 0), 1023)
            cells.add(_geohash_text(-90.0 + (c_lat + 0.5) * h, -180.0 + (c_lon + 0.5) * w, 4))
    cond = None
    for p in sorted(cells):
        c = (F.col(ID) >= F.lit(p)) & (F.col(ID) <= F.lit(p + "z" * 8))
        cond = c if cond is None else cond | c
    hit = lakes.filter(cond).filter(contains(F.col("rings"), F.lit(lon), F.lit(lat)))
    return hit.select(ID).orderBy(ID).limit(1)


def split_in_chunks(df: DataFrame, size: int, order: str = ID, n_ranges: int | None = None) -> DataFrame:
    """Consecutive blocks of ``size`` rows in ``order``: block = position // size + 1.

    Dense positions come from ``dense_position`` (range partitions plus
    offsets), not from a single-partition window.
    """
    from .ordering import dense_position
    pos = dense_position(df, [], [order], "_pos", partitions=n_ranges)
    return pos.withColumn("chunk", (F.floor((F.col("_pos") - 1) / F.lit(size)) + 1).cast("int")).drop("_pos")


#: The projected square that the curve covers: the hemisphere north of the equator lies inside.
CURVE_HALF_SIDE = 12_500_000.0
CURVE_BITS = 16


def lake_curve(lon: Column, lat: Column) -> Column:
    """Place of a lake on the curve: its hemisphere, then the Z-order number of its polar projection.

    The southern hemisphere is projected as its mirror image.
    """
    xy = polar_xy(lon, F.abs(lat))
    south = F.when(lat < 0, F.lit(1 << (2 * CURVE_BITS))).otherwise(F.lit(0)).cast("long")
    return south + curve_key(xy["x"], xy["y"])


def curve_key(px: Column, py: Column) -> Column:
    """Z-order number of a projected point: the bits of its two cell numbers in turn."""
    def cell(v: Column) -> Column:
        top = (1 << CURVE_BITS) - 1
        share = (v + F.lit(CURVE_HALF_SIDE)) / F.lit(2 * CURVE_HALF_SIDE)
        return F.least(F.greatest(F.floor(share * F.lit(float(1 << CURVE_BITS))), F.lit(0)), F.lit(top)).cast("long")

    def spaced(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spaced(cell(px)).bitwiseOR(F.shiftleft(spaced(cell(py)), 1))


def spatial_chunks(lakes: DataFrame, size: int, k: int | None = None, seed: int = 42) -> DataFrame:
    """Spatially compact chunks of at most ``size`` lakes.

    Lakes are put in the order of a space-filling curve over their projected
    centroids and cut into consecutive chunks: one sort, no state that grows
    with the data, and the same chunks on every run. With ``k`` the lakes are
    first clustered by k-means into ``k`` clusters (``k`` centres on the
    driver) and each cluster is cut by id.
    """
    from .ordering import dense_position
    shaped = with_shape_columns(lakes.select(ID, "rings"))
    xy = polar_xy(F.col("cx"), F.col("cy"))
    pts = shaped.select(ID, xy["x"].alias("px"), xy["y"].alias("py"))
    if k is None:
        keyed = shaped.select(ID, F.lit(0).alias("cluster"), lake_curve(F.col("cx"), F.col("cy")).alias("_curve"))
        pos = dense_position(keyed, [], ["_curve", ID], "_pos")
    else:
        if k == 1:  # Spark's KMeans needs k >= 2
            assigned = pts.select(ID, F.lit(0).alias("cluster"))
        else:
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.feature import VectorAssembler
            feats = VectorAssembler(inputCols=["px", "py"], outputCol="features").transform(pts)
            model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(feats)
            assigned = model.transform(feats).select(ID, "cluster")
        pos = dense_position(assigned, ["cluster"], [ID], "_pos")
    piece = F.floor((F.col("_pos") - 1) / F.lit(size)).cast("int").alias("piece")
    return pos.select(ID, "cluster", piece).withColumn("chunk", F.concat_ws("-", "cluster", "piece"))
