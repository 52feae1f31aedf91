"""Pixel and scene tables to lake areas.

The reference delegates this to a remote imagery service; here the same
reductions run as Spark jobs over ``pixels(id_geohash, pixel_id, ts, label,
pixel_area_m2)`` and ``scenes(id_geohash, scene_id, time, cloud_pct,
missing_red)``. Every aggregate is keyed by pixel (or by lake and date) and
partially aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..family import DW_COLUMNS, ID, JRC_COLUMNS
from ..session import written

# JRC yearly water classes in code order 0..3.
JRC_CLASSES = ("area_nodata", "area_land", "area_water_seasonal", "area_water_permanent")
M2_TO_HA = 1e-4


def _mode(label: Column) -> Column:
    """Most frequent label; ties go to the smallest label."""
    return F.mode(label, deterministic=True)


def monthly_mode(pixels: DataFrame) -> DataFrame:
    """Most frequent label of each pixel and calendar month."""
    month = F.trunc(F.col("ts").cast("date"), "month").alias("date")
    return (pixels.filter(F.col("label").isNotNull())
                  .groupBy(ID, "pixel_id", month)
                  .agg(_mode(F.col("label")).alias("label_mode"),
                       F.max("pixel_area_m2").alias("pixel_area_m2")))


def range_mode(pixels: DataFrame, start=None, end=None, year: int | None = None,
               month: int | None = None) -> DataFrame:
    """Most frequent label per pixel over [start, end) or one calendar month.

    The result is stamped with the start date; an empty range gives no rows.
    """
    if year is not None and month is not None:
        start = f"{year:04d}-{month:02d}-01"
        end_col = F.add_months(F.lit(start).cast("date"), 1)
    elif start is not None and end is not None:
        end_col = F.lit(str(end)).cast("date")
    else:
        raise ValueError("give start and end, or year and month")
    start_col = F.lit(str(start)).cast("date")
    d = F.col("ts").cast("date")
    sel = pixels.filter((d >= start_col) & (d < end_col) & F.col("label").isNotNull())
    return (sel.groupBy(ID, "pixel_id")
               .agg(_mode(F.col("label")).alias("label_mode"), F.max("pixel_area_m2").alias("pixel_area_m2"))
               .withColumn("date", start_col))


def class_areas_dw(modes: DataFrame) -> DataFrame:
    """Hectares per DW class (labels 0..8) for each lake and date, as a panel.

    A conditional sum per class (one aggregate, one shuffle; ``pivot`` would
    plan two); every class column exists, 0 ha when no pixel has it.
    """
    return modes.groupBy(ID, "date").agg(*[
        (F.coalesce(F.sum(F.when(F.col("label_mode") == i, F.col("pixel_area_m2"))), F.lit(0.0))
         * F.lit(M2_TO_HA)).alias(name) for i, name in enumerate(DW_COLUMNS)])


def class_areas_jrc(pixels: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Yearly JRC panel: per pixel the year's most frequent label, hectares per
    class whose code equals it, date = 1 January (X4). Pixels of any other
    label count in no class. ``area_nodata`` is dropped (the panel recomputes
    it)."""
    yr = F.year("ts")
    px = pixels.filter(F.col("label").isNotNull())
    if years:
        px = px.filter(yr.isin([int(y) for y in years]))
    modes = (px.groupBy(ID, "pixel_id", yr.alias("year"))
               .agg(_mode(F.col("label")).alias("label_mode"), F.max("pixel_area_m2").alias("pixel_area_m2")))
    cols = {name: (F.coalesce(F.sum(F.when(F.col("label_mode") == i, F.col("pixel_area_m2"))), F.lit(0.0))
                   * F.lit(M2_TO_HA)) for i, name in enumerate(JRC_CLASSES)}
    wide = modes.groupBy(ID, "year").agg(*[cols[c].alias(c) for c in JRC_COLUMNS])
    return wide.select(ID, F.make_date(F.col("year"), F.lit(1), F.lit(1)).alias("date"), *JRC_COLUMNS)


def areas_to_panel(*parts: DataFrame) -> DataFrame:
    """Union of area tables keyed (id, date), date typed, ``reducer`` dropped."""
    if not parts:
        raise ValueError("no area tables given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if "reducer" in out.columns:
        out = out.drop("reducer")
    return out.withColumn("date", F.to_date("date"))


def select_scenes(scenes: DataFrame, start, end, max_cloud: float = 20.0,
                  months: tuple[int, ...] = (6, 7, 8, 9), windows: list[tuple] | None = None) -> DataFrame:
    """Scenes in [start, end), cloud <= limit, summer months, inside any window.

    ``windows`` is a short list of (start, end) pairs given by the caller;
    it becomes an OR of literal ranges in the filter (pushed to the scan).
    """
    t = F.col("time")
    cond = (t >= F.lit(str(start)).cast("timestamp")) & (t < F.lit(str(end)).cast("timestamp"))
    cond = cond & (F.col("cloud_pct") <= F.lit(float(max_cloud)))
    if months:
        cond = cond & F.month(t).isin(list(months))
    if windows:
        w = None
        for a, b in windows:
            c = (t >= F.lit(str(a)).cast("timestamp")) & (t <= F.lit(str(b)).cast("timestamp"))
            w = c if w is None else w | c
        cond = cond & w
    return scenes.filter(cond)


def best_scene_per_date(scenes: DataFrame) -> DataFrame:
    """Per lake and day, the scene with the fewest missing red pixels (X8); ties by scene id."""
    day = F.col("time").cast("date").alias("day")
    return (scenes.groupBy(ID, day)
                  .agg(F.min_by("scene_id", F.struct("missing_red", "scene_id")).alias("scene_id"),
                       F.min("missing_red").alias("missing_red")))


def missing_red(pixels: DataFrame, red: str = "b4") -> DataFrame:
    """``(id, scene_id, time, missing_red)`` from pixels ``(id, scene_id, time, red band)``: missing red values."""
    return (pixels.groupBy(ID, "scene_id", "time")
                  .agg(F.count_if(F.col(red).isNull() | F.isnan(red)).alias("missing_red")))


def best_scene_of_pixels(pixels: DataFrame, red: str = "b4") -> DataFrame:
    """X8 from the pixels themselves: per lake and day the scene with the fewest missing red pixels."""
    return best_scene_per_date(missing_red(pixels, red))


def scene_dates(scenes: DataFrame) -> DataFrame:
    """Distinct days with a scene, per lake."""
    return scenes.select(ID, F.col("time").cast("date").alias("day")).distinct()


def nearest_scene(requests: DataFrame, scenes: DataFrame, key: str = "request_id", at: str = "at",
                  partitions: int | None = None) -> DataFrame:
    """As-of join to the nearest scene on either side (J9), without pairs.

    Requests and scenes are range-partitioned together by (lake, time) and
    written once. Inside a partition one pass forward gives each request the
    last scene before it, one pass backward the first at its time or later.
    What lies beyond a partition's borders comes from the partitions' first
    and last scene of each lake, carried over. A lake, or one day of it, with
    a third of all rows lies in as many partitions as its rows fill.

    Of scenes of one lake and instant the smallest id counts. Ties: the
    earlier scene. Requests without lake or time, or whose lake has no scene,
    get NULL.
    """
    spark = requests.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = {"_req": requests.schema[key].dataType, "_scene": scenes.schema["scene_id"].dataType}
    asked = requests.select(ID, F.col(at).alias("_t"), F.col(key).alias("_req"),
                            F.lit(None).cast(kinds["_scene"]).alias("_scene"), F.lit(0).alias("_kind"),
                            F.monotonically_increasing_id().alias("_tie"))
    # one scene per lake and instant, combined before its shuffle
    offered = (scenes.filter(F.col(ID).isNotNull() & F.col("time").isNotNull())
               .groupBy(ID, F.col("time").alias("_t")).agg(F.min("scene_id").alias("_scene"))
               .select(ID, "_t", F.lit(None).cast(kinds["_req"]).alias("_req"), "_scene", F.lit(1).alias("_kind"),
                       F.lit(0).cast("long").alias("_tie")))
    ranged = written(asked.union(offered).repartitionByRange(n, ID, "_t", "_kind", "_tie")
                     .withColumn("_shard", F.spark_partition_id()), "asof")

    scene = F.when(F.col("_kind") == 1, F.struct(F.col("_t").alias("t"), F.col("_scene").alias("s")))
    grow = (Window.unboundedPreceding, 0)
    order = ["_t", "_kind", "_tie"]  # at equal times the request first: the scene counts as after it
    forward = Window.partitionBy("_shard", ID).orderBy(*order).rowsBetween(*grow)
    backward = Window.partitionBy("_shard", ID).orderBy(*map(F.desc, order)).rowsBetween(*grow)
    inside = (ranged.withColumn("_before", F.last(scene, ignorenulls=True).over(forward))
              .withColumn("_after", F.last(scene, ignorenulls=True).over(backward)).filter("_kind = 0"))

    ends = ranged.groupBy("_shard", ID).agg(F.max(scene).alias("_last"), F.min(scene).alias("_first"))
    earlier = Window.partitionBy(ID).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(ID).orderBy(F.desc("_shard")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_shard", ID, F.last("_last", ignorenulls=True).over(earlier).alias("_left"),
                        F.last("_first", ignorenulls=True).over(later).alias("_right"))
    r = inside.join(carry, ["_shard", ID], "left")
    b, a = F.coalesce("_before", "_left"), F.coalesce("_after", "_right")
    db = F.unix_micros(F.col("_t")) - F.unix_micros(b["t"])
    da = F.unix_micros(a["t"]) - F.unix_micros(F.col("_t"))
    best = F.when(a.isNull() | (b.isNotNull() & (db <= da)), b).otherwise(a)
    best = F.when(F.col(ID).isNotNull() & F.col("_t").isNotNull(), best)
    return r.select(F.col("_req").alias(key), ID, F.col("_t").alias(at),
                    best["s"].alias("scene_id"), best["t"].alias("scene_time"))


def date_window(date: Column, days: int, mode: str = "each") -> Column:
    """``each``: [date - days, date + days]; ``total``: the window of total width ``days`` (M6)."""
    if mode == "each":
        lo, hi = F.date_sub(date, days), F.date_add(date, days)
    elif mode == "total":
        lo, hi = F.date_sub(date, days // 2), F.date_add(date, days - days // 2)
    else:
        raise ValueError(f"no window mode {mode!r}: each or total")
    return F.struct(lo.alias("start"), hi.alias("end"))
