"""Lakes at points through a covering of the lakes' boxes by cells of several sizes.

A lake is entered under the cells that its box touches, of the smallest size
that its box does not exceed: at most two in each direction, so at most four
entries whatever the lake's size. A point has one cell of each size in use.
Both sides meet by equality of the cell and are compared by box at once; only
ids and boxes are shuffled for that. Polygons are fetched by id for the pairs
that are left, and tested exactly.

Lakes that do not overlap cannot crowd a cell, as each is larger than an
eighth of its cells. Points can: a cell that holds a large share of them is
split into as many parts as its share asks for, its points dealt over the
parts and its few lakes entered in each, and the same is done for the
polygons of the lakes that touch such a cell. The shares come from one
pass over the points' cells; they decide where rows go, never what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..family import ID
from ..functions.geometry import contains
from .geo import BOX, with_box

#: Sides of the cells in degrees.
SIZES = (0.01, 0.08, 0.64, 5.12, 40.96, 360.0)
#: Coordinates beyond this many degrees share the last cells.
FAR = 1000.0
#: Cells that may be split, and how many parts a cell with all points gets.
HOT_CELLS = 64


def cell_number(size: Column, v: Column) -> Column:
    """Number of the cell that holds ``v``; never falls as ``v`` rises."""
    return F.floor(F.least(F.greatest(v, F.lit(-FAR)), F.lit(FAR)) / size)


def cell_key(level: Column, ix: Column, iy: Column) -> Column:
    """One long per cell: fewer than 2^20 numbers in each direction."""
    half = 1 << 19
    return (level.cast("long") * (1 << 20) + ix + half) * (1 << 20) + iy + half


def box_level(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The smallest size that the box does not exceed (the largest one for all beyond)."""
    side = F.greatest(maxx - minx, maxy - miny)
    level = F.lit(len(SIZES) - 1)
    for i in reversed(range(len(SIZES) - 1)):
        level = F.when(side <= F.lit(SIZES[i]), F.lit(i)).otherwise(level)
    return F.when(side.isNotNull(), level)


def size_of(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIZES]), level + 1)


def covering(lakes: DataFrame) -> DataFrame:
    """``lakes`` with box columns, plus ``level`` and the array ``cells``, both NULL for lakes without a box."""
    lakes = lakes.withColumn("level", box_level(*[F.col(c) for c in BOX]))
    size = size_of(F.col("level"))
    xs = F.sequence(cell_number(size, F.col("minx")), cell_number(size, F.col("maxx")))
    ys = F.sequence(cell_number(size, F.col("miny")), cell_number(size, F.col("maxy")))
    cells = F.flatten(F.transform(xs, lambda ix: F.transform(ys, lambda iy: cell_key(F.col("level"), ix, iy))))
    return lakes.withColumn("cells", cells)


def hot_cells(probes: DataFrame, parts: int, least: int = 10_000) -> dict[int, int]:
    """How many parts the cells get that hold more than a fair share of the points, and more than ``least``.

    A fair share is one of ``parts`` tasks' rows, so fewer than ``parts``
    cells have more; the ``HOT_CELLS`` fullest of them reach the driver.
    """
    counts = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    fullest = counts.orderBy(F.desc("n"), "cell").limit(HOT_CELLS).collect()
    if not fullest:
        return {}
    total = probes.count()
    return {r.cell: min(parts, -(-r.n * parts // total)) for r in fullest if r.n * parts > total}


def lake_at_points(points: DataFrame, lakes: DataFrame, lat: str = "lat", lon: str = "lon",
                   key: str = "point_id") -> DataFrame:
    """Lake containing each point (J8): ``(key, id_geohash or NULL)``; of several lakes the smallest id.

    Points without coordinates and lakes without a polygon match nothing.
    """
    spark = points.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pts = points.select(key, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    boxed = with_box(lakes)
    used = covering(boxed).select("level").distinct().collect()  # at most one per size
    levels = sorted(r.level for r in used if r.level is not None)
    if not levels:
        return pts.select(key, F.lit(None).cast("string").alias(ID))
    cells = [cell_key(F.lit(i), cell_number(F.lit(SIZES[i]), F.col("_lon")), cell_number(F.lit(SIZES[i]), F.col("_lat")))
             for i in levels]
    probes = pts.withColumn("cell", F.explode(F.array(*cells))).filter(F.col("cell").isNotNull())
    hot = hot_cells(probes.select("cell"), parts)

    covered = covering(boxed)
    entries = covered.select(ID, *BOX, F.explode("cells").alias("cell"))
    polygons = lakes.select(ID, "rings")
    if hot:
        share = F.create_map(*[F.lit(v) for pair in hot.items() for v in pair])
        probes = probes.withColumn("_part", 
                                   F.coalesce(F.pmod(F.xxhash64(key, "_lat", "_lon"), share[F.col("cell")]), F.lit(0)).cast("int"))
        entries = entries.withColumn("_part", F.explode(
            F.sequence(F.lit(0), F.coalesce(share[F.col("cell")], F.lit(1)) - 1)))
        most = F.array_max(F.transform("cells", lambda c: F.coalesce(share[c], F.lit(1))))
        polygons = (covered.select(ID, "rings", F.explode(F.sequence(F.lit(0), most - 1)).alias("_part")))
    else:
        probes, entries = probes.withColumn("_part", F.lit(0)), entries.withColumn("_part", F.lit(0))
        polygons = polygons.withColumn("_part", F.lit(0))
    inside = F.col("_lon").between(F.col("minx"), F.col("maxx")) & F.col("_lat").between(F.col("miny"), F.col("maxy"))
    pairs = probes.join(entries, ["cell", "_part"]).filter(inside).select(key, "_lat", "_lon", ID, "_part")
    hits = (pairs.join(polygons, [ID, "_part"]).filter(contains(F.col("rings"), F.col("_lon"), F.col("_lat")))
            .groupBy(key).agg(F.min(ID).alias(ID)))
    return pts.select(key).join(hits, key, "left")
