"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the driver's tables (or panels Spark derives from them) and run
the library operators over the whole input. Numeric report columns are
rounded to 4 places at the very end so the DuckDB oracle can be compared
value for value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..family import DW, JRC
from ..functions.numeric import round_output
from pyspark.sql import functions as F

from ..family import DATE, ID
from ..operators.breaks import simple_breaks
from ..operators.merge import merge_panels
from ..operators.panel import gap_report
from ..operators.rolling import rolling
from ..functions.geohash import geohash_decode, geohash_encode, geohash_label
from ..operators.covering import lake_at_points
from ..operators.geo import BOX, bbox_area_km2, filter_bbox, grid_counts, split_in_chunks, total_bounds
from ..operators.views import largest_lakes
from ..sources.derived import (SQUARE_SIDE, jrc_pixel_table, padded, pixel_table, scene_table, square_corner,
                               square_lakes)
from ..operators.pixels import (best_scene_per_date, class_areas_dw, class_areas_jrc, monthly_mode,
                                nearest_scene, range_mode, scene_dates, select_scenes)
from ..operators.views import compare_sources, relative_percent, series_with_break, to_long, to_long_jrc
from ..operators.nrt import nrt_breaks
from ..operators.panel import prepare
from ..operators.stats import counts_matrix, history_stats
from ..operators.views import ranked_drained
from ..sources.derived import planted_jrc, planted_panel, ship_panel
from .nrt_jobs import nrt_month, nrt_range, nrt_range_counts

# Fixed query parameters of the registered NRT queries.
NRT_DATE = "2019-06"
SHIP_NRT_DATE = "1998-06"
RANGE_START, RANGE_END = "2018-01", "2021-12"


def q_simple_breaks(spark: SparkSession, sf_dir: str, method: str = "median") -> DataFrame:
    prepared = prepare(planted_panel(spark, sf_dir), DW)
    return round_output(simple_breaks(prepared, DW, window=3, method=method, threshold=-0.25))


def q_simple_breaks_jrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = prepare(planted_jrc(spark, sf_dir), JRC)
    return round_output(simple_breaks(prepared, JRC, window=3, method="median", threshold=-0.25))


# The ship panel's "water" class is one ninth of the total, so a drop of a
# quarter of the lake never happens there; its detector runs at -0.1.
SHIP_THRESHOLD = -0.1


def q_simple_breaks_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = prepare(ship_panel(spark, sf_dir), DW, nodata_max=1.0)
    return round_output(simple_breaks(prepared, DW, window=3, method="median", threshold=SHIP_THRESHOLD))


def q_nrt(spark, sf_dir, period="all", keep_nans=False):
    prepared = prepare(planted_panel(spark, sf_dir), DW)
    return round_output(nrt_breaks(prepared, DW, NRT_DATE, period=period, keep_nans=keep_nans))


def q_nrt_ship(spark, sf_dir):
    prepared = prepare(ship_panel(spark, sf_dir), DW, nodata_max=1.0)
    return round_output(nrt_breaks(prepared, DW, SHIP_NRT_DATE))


def q_history_stats(spark, sf_dir):
    prepared = prepare(planted_panel(spark, sf_dir), DW)
    return round_output(history_stats(prepared, DW, before="2019-06-01"))


def q_drained_month(spark, sf_dir):
    return round_output(nrt_month(planted_panel(spark, sf_dir), NRT_DATE, DW))


def q_nrt_range(spark, sf_dir):
    return round_output(nrt_range(planted_panel(spark, sf_dir), RANGE_START, RANGE_END, DW))


def q_nrt_range_monthly(spark, sf_dir):
    """Range job with same-calendar-month history (``period='monthly'``)."""
    return round_output(nrt_range(planted_panel(spark, sf_dir), RANGE_START, RANGE_END, DW, period="monthly",
                                  drained_only=False))


def q_monthly_counts(spark, sf_dir):
    return nrt_range_counts(planted_panel(spark, sf_dir), RANGE_START, RANGE_END, DW)


def q_counts_matrix(spark, sf_dir):
    return round_output(counts_matrix(q_monthly_counts(spark, sf_dir)))


def q_ranked_drained(spark, sf_dir):
    return round_output(ranked_drained(nrt_range(planted_panel(spark, sf_dir), RANGE_START, RANGE_END, DW)))


def q_prepare_panel(spark, sf_dir):
    return round_output(prepare(ship_panel(spark, sf_dir), DW, nodata_max=1.0))


def q_mask_panel(spark, sf_dir):
    p = prepare(planted_panel(spark, sf_dir), DW)
    return round_output(p.select(ID, DATE, "water", "water_norm", "snow_and_ice_norm", "area_nodata", "valid"))


def q_gap_report(spark, sf_dir):
    # default mask (nodata_max = 0) on the ship panel leaves large gaps
    return round_output(gap_report(prepare(ship_panel(spark, sf_dir), DW), "water"))


def q_rolling(spark, sf_dir, method="median"):
    p = prepare(ship_panel(spark, sf_dir), DW, nodata_max=1.0).filter(F.col("valid"))
    v = F.col("water_norm")
    return round_output(p.select(ID, DATE, v.alias("water_norm"),
                                 rolling(v, method, 3).alias("roll_3"),
                                 rolling(v, method, 5).alias("roll_5")))


SPLIT_DATE_A, SPLIT_DATE_B = "1998-01-01", "1997-01-01"


def q_merge(spark, sf_dir, how="both"):
    """Two overlapping halves merged back: by date on the ship panel; by lake
    on the planted panel (dense, so both halves share one date set)."""
    if how in ("both", "date"):
        panel = ship_panel(spark, sf_dir)
        a = panel.filter(F.col(DATE) < F.lit(SPLIT_DATE_A).cast("date"))
        b = panel.filter(F.col(DATE) >= F.lit(SPLIT_DATE_B).cast("date"))
    else:
        panel = planted_panel(spark, sf_dir)
        k = F.expr(f"substring({ID}, 3)").cast("long")
        a = panel.filter((k % 2 == 0) | (k % 5 == 0))
        b = panel.filter((k % 2 == 1) | (k % 5 == 0))
    return round_output(merge_panels(a, b, how=how))


def q_to_long(spark, sf_dir):
    return round_output(to_long(ship_panel(spark, sf_dir)))


def q_relative_percent(spark, sf_dir):
    from ..operators.views import relative_long
    return round_output(relative_long(ship_panel(spark, sf_dir)))


def q_compare_sources(spark, sf_dir):
    dw = prepare(planted_panel(spark, sf_dir), DW)
    jrc = prepare(planted_jrc(spark, sf_dir), JRC)
    return round_output(compare_sources(to_long(dw), to_long_jrc(jrc)))


def q_series_with_break(spark, sf_dir):
    panel = planted_panel(spark, sf_dir)
    breaks = simple_breaks(prepare(panel, DW), DW)
    return round_output(series_with_break(panel.select(ID, DATE, "water"), breaks))


LAKE_ATTRS = ["Area_start_ha", "Area_end_ha", "NetChange_ha", "NetChange_perc"]


def lakes_flat(lakes):
    """Scalar view of polygons: id, key, attributes, centroid, planar area."""
    from ..functions.geometry import with_shape_columns
    return with_shape_columns(lakes).select(ID, "lake_key", *LAKE_ATTRS, "cx", "cy", "area_deg2")


def q_square_lakes(spark, sf_dir):
    return round_output(lakes_flat(square_lakes(spark, sf_dir)), 6)


BBOX = dict(west=-164.5, south=61.0, east=-160.0, north=63.0)


def q_bbox_filter(spark, sf_dir):
    return round_output(lakes_flat(filter_bbox(square_lakes(spark, sf_dir), **BBOX)), 6)


def q_grid_counts(spark, sf_dir):
    return grid_counts(square_lakes(spark, sf_dir), dlon=1.0, dlat=0.5)


def q_bounds(spark, sf_dir):
    return round_output(total_bounds(square_lakes(spark, sf_dir)), 6)


def q_bbox_area_km2(spark, sf_dir):
    return round_output(bbox_area_km2(square_lakes(spark, sf_dir)), 2)


def q_largest_lakes(spark, sf_dir):
    top = largest_lakes(square_lakes(spark, sf_dir), n=20)
    return top.select(ID, "lake_key", "Area_start_ha")


def click_points(spark, sf_dir):
    """One probe point per order near its customer's lake: inside for
    offsets 0 and +-0.0013 degrees, outside for +-0.0026 and +-0.0039."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    k = F.col("o_custkey")
    x0, y0 = square_corner(k)
    cx, cy = x0 + F.lit(0.002), y0 + F.lit(0.002)
    dx = ((F.col("o_orderkey") % 7) - 3).cast("double") * F.lit(0.0013)
    dy = ((F.col("o_orderkey") % 5) - 2).cast("double") * F.lit(0.0013)
    return o.select(F.col("o_orderkey").alias("point_id"), (cy + dy).alias("lat"), (cx + dx).alias("lon"))


def q_lake_at_points(spark, sf_dir):
    return lake_at_points(click_points(spark, sf_dir), square_lakes(spark, sf_dir))


def q_geohash_decode(spark, sf_dir):
    lk = square_lakes(spark, sf_dir).select(ID)
    d = geohash_decode(F.col(ID))
    return round_output(lk.select(ID, d["lat"].alias("lat"), d["lon"].alias("lon"),
                                  geohash_label(F.col(ID)).alias("label"),
                                  geohash_encode(d["lat"], d["lon"], 12).alias("reencoded"),
                                  geohash_encode(d["lat"], d["lon"], 5).alias("prefix5")), 6)


def q_split_in_chunks(spark, sf_dir):
    return split_in_chunks(square_lakes(spark, sf_dir).select(ID), size=100)


def q_monthly_mode(spark, sf_dir):
    return round_output(monthly_mode(pixel_table(spark, sf_dir)))


def q_range_mode(spark, sf_dir):
    return round_output(range_mode(pixel_table(spark, sf_dir), "2024-01-08", "2024-01-22"))


def q_class_areas(spark, sf_dir):
    return round_output(class_areas_dw(monthly_mode(pixel_table(spark, sf_dir))), 6)


def q_class_areas_jrc(spark, sf_dir):
    return round_output(class_areas_jrc(jrc_pixel_table(spark, sf_dir), years=[2024]), 6)


SCENE_WINDOWS = [("2024-01-03", "2024-01-10"), ("2024-01-15 12:00:00", "2024-01-25")]


def q_select_scenes(spark, sf_dir):
    sel = select_scenes(scene_table(spark, sf_dir), "2024-01-01", "2024-02-01", max_cloud=20.0,
                        months=(1,), windows=SCENE_WINDOWS)
    return round_output(sel)


def q_best_scene(spark, sf_dir):
    return best_scene_per_date(scene_table(spark, sf_dir))


def q_scene_dates(spark, sf_dir):
    return scene_dates(scene_table(spark, sf_dir))


def scene_requests(spark, sf_dir):
    """One imagery request per order: a lake of the pixel table and an hour in January 2024."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    at = (F.lit("2024-01-01").cast("timestamp")
          + F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 30).cast("int"),
                            (F.col("o_orderkey") % 24).cast("int")))
    return o.select(F.col("o_orderkey").alias("request_id"),
                    F.concat(F.lit("px"), padded(F.col("o_custkey") % 10)).alias(ID),
                    at.alias("at"))


def q_nearest_scene(spark, sf_dir):
    return nearest_scene(scene_requests(spark, sf_dir), scene_table(spark, sf_dir))


def _kernel_prepared(spark, sf_dir):
    """Planted panel prepared with a fixed task count for the Python kernels."""
    from ..session import kernel_partitions
    return prepare(planted_panel(spark, sf_dir), DW, partitions=kernel_partitions(spark))


def q_bayes_breaks(spark, sf_dir):
    from ..operators.bayes import bayes_breaks
    return round_output(bayes_breaks(_kernel_prepared(spark, sf_dir), DW))


def q_bayes_first_break(spark, sf_dir):
    """The most probable change of each lake (D2), with its calendar neighbours and statistics."""
    from ..operators.bayes import bayes_breaks
    found = bayes_breaks(_kernel_prepared(spark, sf_dir), DW, min_sep=3)
    return round_output(found.filter("break_number = 1").drop("proba", "break_number"))


def q_nrt_arima(spark, sf_dir):
    prepared = _kernel_prepared(spark, sf_dir)
    return round_output(nrt_breaks(prepared, DW, NRT_DATE, forecast="arima"))


def q_user_detector(spark, sf_dir):
    """A detector registered at run time (D10): first valid date whose water is
    below half of the lake's first valid value."""
    from ..operators.breaks import register_detector, run_detector

    def half_drop(pdf):
        import pandas as pd
        hit = pdf[pdf["water_norm"] < pdf["water_norm"].iloc[0] / 2]
        if hit.empty:
            return pd.DataFrame({ID: pd.Series(dtype=str), "date_break": pd.Series(dtype="object"),
                                 "date_before_break": pd.Series(dtype="object"),
                                 "date_after_break": pd.Series(dtype="object")})
        k = hit.index[0]
        prev = pdf[DATE].iloc[k - 1] if k > 0 else None
        nxt = pdf[DATE].iloc[k + 1] if k + 1 < len(pdf) else None
        return pd.DataFrame({ID: [pdf[ID].iloc[0]], "date_break": [pdf[DATE].iloc[k]],
                             "date_before_break": [prev], "date_after_break": [nxt]})

    register_detector("half_drop", half_drop)
    return round_output(run_detector(_kernel_prepared(spark, sf_dir), DW, "half_drop"))


def q_spatial_chunks(spark, sf_dir):
    from ..operators.geo import spatial_chunks
    return spatial_chunks(square_lakes(spark, sf_dir), size=100)


HIST_BBOX = dict(west=-164.9, east=-164.3)


def q_historical_breaks(spark, sf_dir):
    from .historical import historical_breaks
    lakes = square_lakes(spark, sf_dir, source="supplier")
    out = historical_breaks(planted_panel(spark, sf_dir), lakes, bbox=HIST_BBOX)
    return round_output(out.drop("rings"))


def q_gridded_nrt(spark, sf_dir):
    from .gridded import gridded_nrt
    panel = planted_panel(spark, sf_dir)
    d = F.lit("2019-06-01").cast("date")
    history, new_month = panel.filter(F.col(DATE) < d), panel.filter(F.col(DATE) == d)
    lakes = square_lakes(spark, sf_dir, source="supplier")
    return round_output(gridded_nrt(history, new_month, lakes, "2019-06-01", dlon=0.5, dlat=1.0))


def _scratch(spark, name):
    import uuid
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/queries/{name}-{uuid.uuid4().hex}"


def q_clustered_roundtrip(spark, sf_dir):
    """Write the lakes clustered by id with small row groups (K4), read back."""
    from ..sinks.writers import cluster_by_key
    path = _scratch(spark, "clustered")
    cluster_by_key(square_lakes(spark, sf_dir), path, rows_per_group=200)
    return round_output(lakes_flat(spark.read.parquet(path)), 6)


def q_month_files_roundtrip(spark, sf_dir):
    """Drained lakes of the range written as month partitions (K3), read back."""
    from ..sinks.writers import write_nrt_month
    from ..sources.readers import read_nrt_results
    path = _scratch(spark, "months")
    write_nrt_month(nrt_range(planted_panel(spark, sf_dir), RANGE_START, RANGE_END, DW), path)
    return round_output(read_nrt_results(spark, path))


def q_wkb_roundtrip(spark, sf_dir):
    """Lakes written as WKB GeoParquet columns, read back (S3, K2)."""
    from ..functions.wkb import rings_to_wkb
    from ..sources.readers import read_lakes
    path = _scratch(spark, "wkb")
    rings_to_wkb(square_lakes(spark, sf_dir)).write.parquet(path)
    return round_output(lakes_flat(read_lakes(spark, path)), 6)


def q_geojson_roundtrip(spark, sf_dir):
    """Features of both polygon kinds written as GeoJSON lines, read back (S3, K5)."""
    from ..functions.geometry import with_shape_columns
    from ..sources.readers import read_lakes
    path = _scratch(spark, "geojson")
    lakes = square_lakes(spark, sf_dir)
    coords = F.transform("rings", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    props = F.struct(ID, "lake_key").alias("properties")
    many = F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")).alias("geometry")
    one = F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")).alias("geometry")
    kind = F.lit("Feature").alias("type")
    odd = lakes.filter("lake_key % 2 = 1").select(F.to_json(F.struct(kind, props, many)).alias("value"))
    even = lakes.filter("lake_key % 2 = 0").select(F.to_json(F.struct(kind, props, one)).alias("value"))
    odd.union(even).write.text(path)
    back = with_shape_columns(read_lakes(spark, path, fmt="json"))
    return round_output(back.select(ID, "lake_key", "cx", "cy", "area_deg2"), 6)


def q_break_files_union(spark, sf_dir):
    """Break tables of two detectors and of other column types, merged by name."""
    from ..sources.readers import read_break_files
    base = _scratch(spark, "breaks")
    prepared = prepare(planted_panel(spark, sf_dir), DW)
    cols = [ID, "date_break", "break_method", "water_change_ha"]
    simple_breaks(prepared, DW).select(*cols).write.parquet(f"{base}/a")
    coarse = simple_breaks(prepared, DW, window=5).select(
        *cols[:3], F.round("water_change_ha").cast("int").alias("water_change_ha"), "date_break_year")
    coarse.write.parquet(f"{base}/b")
    return round_output(read_break_files(spark, [f"{base}/a", f"{base}/b"]))


def q_nrt_job_rerun(spark, sf_dir):
    """The written range job run three times, resumed and from scratch: counts per month."""
    from .nrt_jobs import run_nrt_range
    out = _scratch(spark, "rerun")
    panel = planted_panel(spark, sf_dir)
    run_nrt_range(panel, "2019-03", "2019-06", out, DW)
    run_nrt_range(panel, "2019-03", "2019-08", out, DW)
    return run_nrt_range(panel, "2019-03", "2019-08", out, DW, resume=False)


def q_stream_replay(spark, sf_dir):
    """Two months as stream batches, each delivered twice: counts per month (T4)."""
    from ..streaming.monthly_stream import process_batch
    out = _scratch(spark, "stream")
    panel = planted_panel(spark, sf_dir)
    month = F.date_format(DATE, "yyyy-MM")
    panel.filter(month < "2019-05").write.parquet(f"{out}/history")
    for k, m in enumerate(("2019-05", "2019-06")):
        for _ in range(2):
            process_batch(panel.filter(month == m), f"{out}/history", out, DW, batch_id=k)
    from .nrt_jobs import read_counts
    return read_counts(spark, f"{out}/counts")


def q_geojson_lines(spark, sf_dir):
    from ..sinks.writers import geojson_lines
    return geojson_lines(square_lakes(spark, sf_dir))


def q_rescale_attach(spark, sf_dir):
    from ..operators.nrt import rescale_and_attach
    panel = planted_panel(spark, sf_dir)
    nrt = nrt_breaks(prepare(panel, DW), DW, NRT_DATE)
    lakes = square_lakes(spark, sf_dir, source="supplier")
    return round_output(rescale_and_attach(nrt, panel, lakes, DW).drop("rings"))


def q_valid_keys(spark, sf_dir):
    """Data-quality flags over lake ids, months and probe coordinates."""
    from ..functions.validators import is_geohash, is_lat, is_lon, is_month
    pts = click_points(spark, sf_dir)
    lakes = square_lakes(spark, sf_dir).select(ID)
    month = F.date_format(F.col("o_orderdate"), "yyyy-MM")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    flags = (pts.join(orders, pts["point_id"] == orders["o_orderkey"])
                .select("point_id", is_lat(F.col("lat")).alias("lat_ok"), is_lon(F.col("lon")).alias("lon_ok"),
                        is_month(month).alias("month_ok"), is_month(F.col("o_orderkey").cast("string")).alias("key_is_month")))
    ids = lakes.select(ID, is_geohash(F.col(ID)).alias("id_ok"),
                       is_geohash(F.concat(F.col(ID), F.lit("x"))).alias("id13_ok"))
    return flags.groupBy("lat_ok", "lon_ok", "month_ok", "key_is_month").count().unionByName(
        ids.groupBy("id_ok", "id13_ok").count(), allowMissingColumns=True)


def q_panel_io(spark, sf_dir):
    """A panel written by year, described and read back."""
    from ..sinks.writers import describe_columns, write_panel
    from ..sources.readers import read_panel
    path = _scratch(spark, "panel")
    write_panel(describe_columns(ship_panel(spark, sf_dir)), path)
    return round_output(read_panel(spark, path).select(ID, DATE, *DW.classes))


def q_lake_lookup(spark, sf_dir):
    """Polygons of a set of ids from a clustered table (S5, K4): the lakes of customers with an order in 1995."""
    from ..functions.geohash import geohash_encode
    from ..sinks.writers import cluster_by_key
    from ..sources.readers import read_lakes_in
    path = _scratch(spark, "lookup")
    cluster_by_key(square_lakes(spark, sf_dir), path, rows_per_group=200)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.year("o_orderdate") == 1995)
    x, y = square_corner(F.col("o_custkey"))
    ids = o.select(geohash_encode(y + F.lit(SQUARE_SIDE / 2), x + F.lit(SQUARE_SIDE / 2), 12).alias(ID))
    return round_output(lakes_flat(read_lakes_in(spark.read.parquet(path), ids)), 6)


def q_date_lists(spark, sf_dir):
    """Orders on listed dates (S8, S9): first days of summer months, every tenth day of 1996, first days of years."""
    from ..sources.readers import annual_dates, monthly_dates, stepped_dates
    lists = (monthly_dates(spark, [1994, 1995], [6, 7, 8]).withColumn("list", F.lit("months"))
             .unionByName(stepped_dates(spark, "1996-01-01", 10, end="1996-12-31").withColumn("list", F.lit("steps")))
             .unionByName(annual_dates(spark, [1993, 1997]).withColumn("list", F.lit("years"))))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"))
    n = o.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return (lists.join(n, lists[DATE] == n["day"], "left")
                 .select("list", DATE, F.coalesce("n", F.lit(0)).alias("n_orders")))


def q_row_shares(spark, sf_dir):
    """Row-wise shares of one date and of all earlier ones."""
    from ..operators.panel import normalize_rows, split_at
    p = prepare(ship_panel(spark, sf_dir), DW, nodata_max=1.0).select(ID, DATE, "water", "area_data", "area_nodata")
    at, before = split_at(normalize_rows(p), "1997-06-01")
    return round_output(at.withColumn("part", F.lit("at")).unionByName(before.withColumn("part", F.lit("before"))))


def q_break_views(spark, sf_dir):
    """Breaks written with every lake's polygon, read back without stable lakes."""
    from ..operators.views import hide_stable
    from ..sinks.writers import write_breaks
    path = _scratch(spark, "views")
    lakes = square_lakes(spark, sf_dir, source="supplier")
    write_breaks(simple_breaks(prepare(planted_panel(spark, sf_dir), DW), DW), lakes, path, all_lakes=True)
    found = hide_stable(spark.read.parquet(path))
    return found.select(ID, "lake_key", "Area_start_ha", "date_break", "date_break_year")


def q_month_view(spark, sf_dir):
    """One month of a written range, confident lakes only, with year and month."""
    from ..operators.views import hide_stable, month_parts, pick_month
    from ..sinks.writers import write_nrt_month
    from ..sources.readers import read_nrt_results
    path = _scratch(spark, "month")
    write_nrt_month(nrt_range(planted_panel(spark, sf_dir), "2019-04", "2019-07", DW, drained_only=False), path)
    month = hide_stable(pick_month(read_nrt_results(spark, path), NRT_DATE), "nrt")
    return month_parts(month).select(ID, "analysis_month", "year", "month", "drainage_confidence")


def q_availability(spark, sf_dir):
    """Suppliers that ship in 1998: whether the ship panel of earlier years holds them."""
    from ..operators.panel import availability, filter_ids
    panel = ship_panel(spark, sf_dir)
    earlier = panel.filter(F.col(DATE) < F.lit("1992-04-01").cast("date"))
    later = panel.filter(F.col(DATE) >= F.lit("1998-01-01").cast("date")).select(ID).distinct()
    kept, missing = filter_ids(earlier, later, on_missing="ignore")
    rows = kept.groupBy(ID).agg(F.count(F.lit(1)).alias("n_rows"))
    return availability(earlier, later).join(rows.unionByName(missing.withColumn("n_rows", F.lit(0))), ID)


def q_area_tables(spark, sf_dir):
    """Area tables of two halves of the pixels put together as one panel."""
    from ..operators.pixels import areas_to_panel
    modes = monthly_mode(pixel_table(spark, sf_dir))
    parts = [class_areas_dw(modes.filter(cond)).withColumn("reducer", F.lit("mode"))
             for cond in (f"{DATE} < '2024-01-15'", f"{DATE} >= '2024-01-15'")]
    return round_output(areas_to_panel(*parts), 6)


def q_lakes_in_box(spark, sf_dir):
    """Lakes written with box columns along the curve, those in a box read back."""
    from ..sinks.writers import write_lakes
    from ..sources.readers import read_lakes
    path = _scratch(spark, "boxed")
    write_lakes(square_lakes(spark, sf_dir), path, rows_per_group=200)
    return round_output(lakes_flat(read_lakes(spark, path, bbox=BBOX)), 6)


def q_historical_run(spark, sf_dir):
    """The written historical job, all lakes of the run (D8): a polygon per customer, a panel per supplier, a box."""
    from ..sinks.writers import write_lakes
    from .historical import run_historical
    base = _scratch(spark, "historical")
    lakes = square_lakes(spark, sf_dir).withColumn(ID, F.concat(F.lit("lk"), padded(F.col("lake_key"))))
    write_lakes(lakes, f"{base}/lakes", rows_per_group=200)
    run_historical(planted_panel(spark, sf_dir), spark.read.parquet(f"{base}/lakes"), f"{base}/out", bbox=HIST_BBOX,
                   all_lakes=True)
    return round_output(spark.read.parquet(f"{base}/out").drop("rings", *BOX))


def q_lake_point_reads(spark, sf_dir):
    """Thirty lakes looked up by id in a clustered table, and the row groups that a look-up reads."""
    from ..sinks.writers import cluster_by_key
    from ..sources.footers import parquet_footers, row_groups_holding
    path = _scratch(spark, "points")
    cluster_by_key(square_lakes(spark, sf_dir), path, rows_per_group=2000)
    lakes = spark.read.parquet(path)
    # the thirty ids are the question
    ids = [r[0] for r in lakes.orderBy(F.md5(F.concat(ID, F.lit("42"))), ID).limit(30).select(ID).collect()]
    touched = row_groups_holding(parquet_footers(spark, [path], key=ID), ids)
    found = lakes.filter(F.col(ID).isin(ids)).select(ID, "lake_key", "Area_start_ha")
    return found.join(touched, found[ID] == touched["key"]).drop("key")


def q_grid_cells(spark, sf_dir):
    """Every cell of a longitude and latitude grid with its number of lakes."""
    from ..operators.geo import lonlat_grid
    grid = lonlat_grid(spark, (-166.0, -160.0), (60.0, 66.0), 1.0, 0.5)
    found = grid_counts(square_lakes(spark, sf_dir), dlon=1.0, dlat=0.5)
    return (grid.join(found, (grid["lon"] == found["cell_lon"]) & (grid["lat"] == found["cell_lat"]), "left")
                .select("lon", "lat", F.coalesce("n_lakes", F.lit(0)).alias("n_lakes")))


def q_consolidated_months(spark, sf_dir):
    """A written range consolidated into one table, its drained lakes joined to their polygons."""
    from ..operators.geo import attach_geometry
    from .nrt_jobs import consolidate, run_nrt_range
    out = _scratch(spark, "months")
    run_nrt_range(planted_panel(spark, sf_dir), "2019-03", "2019-08", out, DW)
    breaks, counts = consolidate(out, spark, f"{out}/all")
    lakes = square_lakes(spark, sf_dir, source="supplier").select(ID, "lake_key", "rings")
    placed = attach_geometry(breaks.select("analysis_month", ID, "water_residual"), lakes, "inner")
    rows = placed.filter(F.size("rings") > 0).select("analysis_month", ID, "lake_key", "water_residual")
    return round_output(rows.join(counts, "analysis_month"))


def q_request_windows(spark, sf_dir):
    """Date windows around each order: as many days on both sides, and of a total width (M6)."""
    from ..operators.pixels import date_window
    day = F.col("o_orderdate").cast("date")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    each, total = date_window(day, 45, "each"), date_window(day, 45, "total")
    return o.select("o_orderkey", each["start"].alias("each_start"), each["end"].alias("each_end"),
                    total["start"].alias("total_start"), total["end"].alias("total_end"))


def q_clipped_change(spark, sf_dir):
    """The change of each lake as a map colours it: missing values filled, then clipped."""
    from ..functions.numeric import clip_value
    lakes = square_lakes(spark, sf_dir)
    shown = F.when(F.col("lake_key") % 4 != 0, F.col("NetChange_ha"))
    return round_output(lakes.select(ID, clip_value(shown, 0.0, -8.0, 8.0).alias("colour"),
                                     clip_value(None, 1.5).alias("no_column")))


def q_usable_polygons(spark, sf_dir):
    """Polygons with a third coordinate, some missing or empty: the usable ones, flat."""
    from ..functions.geometry import drop_z
    from ..operators.geo import filter_valid_geometry
    lakes = square_lakes(spark, sf_dir)
    tall = F.transform("rings", lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(7.0).alias("z")))))
    empty = F.array().cast("array<array<array<struct<x:double,y:double,z:double>>>>")
    odd = F.when(F.col("lake_key") % 10 == 3, None).when(F.col("lake_key") % 10 == 6, empty).otherwise(tall)
    usable = filter_valid_geometry(lakes.withColumn("rings", odd))
    return round_output(lakes_flat(usable.withColumn("rings", drop_z(F.col("rings")))), 6)


def q_site_values(spark, sf_dir):
    """The valid dates of one lake, two of its variables as long rows."""
    from ..operators.panel import site_series
    from ..operators.views import pick_variables
    prepared = prepare(planted_panel(spark, sf_dir), DW)
    series = site_series(prepared, "lk000003", [*DW.classes, "area_nodata"])
    return round_output(pick_variables(to_long(series), ["water", "bare"]))


def q_panel_keys(spark, sf_dir):
    """Distinct lakes and dates of the ship panel, by year of the date (F16)."""
    from ..operators.panel import dates, object_ids
    panel = ship_panel(spark, sf_dir)
    lakes = object_ids(panel).agg(F.count(F.lit(1)).alias("n"))
    per_year = dates(panel).groupBy(F.year(DATE).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_year.unionByName(lakes.select(F.lit("lakes").alias("key"), "n"))


def q_described_panel(spark, sf_dir):
    """Units and families that a written panel's columns carry, with each variable's total (K8, K1)."""
    from ..sinks.writers import describe_columns, write_panel
    path = _scratch(spark, "described")
    write_panel(describe_columns(ship_panel(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    told = [f for f in back.schema if f.metadata.get("unit")]
    totals = back.agg(*[F.sum(f.name).alias(f.name) for f in told])
    rows = F.array(*[F.struct(F.lit(f.name).alias("variable"), F.lit(f.metadata["unit"]).alias("unit"),
                              F.lit(f.metadata["family"]).alias("family"), F.col(f.name).alias("total")) for f in told])
    return round_output(totals.select(F.inline(rows)))


def q_geojson_written(spark, sf_dir):
    """Polygons and centroid points written as GeoJSON lines and read back (K5, M9, S3)."""
    from ..functions.geometry import with_shape_columns
    from ..sinks.writers import write_geojsonseq
    from ..sources.readers import read_lakes
    path = _scratch(spark, "geojsonseq")
    write_geojsonseq(square_lakes(spark, sf_dir), path, props=(ID, "lake_key", "Area_start_ha", "NetChange_perc"))
    lakes = with_shape_columns(read_lakes(spark, path, fmt="json"))
    point = "geometry struct<type: string, coordinates: array<double>>, properties struct<id_geohash: string>"
    points = spark.read.schema(point).json(f"{path}_points").select(
        F.col("properties.id_geohash").alias("point_id"), F.col("geometry.coordinates")[0].alias("px"),
        F.col("geometry.coordinates")[1].alias("py"))
    both = lakes.join(points, lakes[ID] == points["point_id"])
    return round_output(both.select(ID, "lake_key", "Area_start_ha", "NetChange_perc", "cx", "cy", "area_deg2", "px", "py"), 6)


def scene_pixels(spark, sf_dir):
    """Pixels of imagery scenes from events: ten lakes, a scene per half day, the red band missing where it failed."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type", "value")
    half = F.floor(F.hour("ts") / 12).cast("int")
    lake = F.concat(F.lit("px"), padded(F.col("user_id") % 10))
    return ev.select(lake.alias(ID),
                     F.concat_ws("-", lake, F.date_format("ts", "yyyyMMdd"), half.cast("string")).alias("scene_id"),
                     (F.date_trunc("day", "ts") + F.make_interval(hours=half * 12)).alias("time"),
                     F.when(F.col("event_type") != "error", F.col("value")).alias("b4"))


def q_best_scene_of_pixels(spark, sf_dir):
    """Per lake and day the scene with the fewest missing red pixels, counted from the pixels."""
    from ..operators.pixels import best_scene_of_pixels
    return best_scene_of_pixels(scene_pixels(spark, sf_dir))


def line_panel(spark, sf_dir):
    """A lake per supplier whose water share is a line in time, steeper for some; 48 months."""
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    rows = sup.select("k", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("m"))
    share = F.lit(0.9) - (F.col("m") * (F.col("k") % 5)).cast("double") * F.lit(0.002)
    return rows.select(F.concat(F.lit("ln"), padded(F.col("k"))).alias(ID),
                       F.add_months(F.lit("2018-01-01").cast("date"), F.col("m")).alias(DATE), share.alias("share"))


def q_forecast_lines(spark, sf_dir):
    """Series with a known next value: what maximum-likelihood ARIMA forecasts for lines and constants."""
    from ..operators.forecast import arima_forecast
    found = arima_forecast(line_panel(spark, sf_dir), "share", method="arima_ml")
    width = F.col("water_predicted_upper_90") - F.col("water_predicted_lower_90")
    return round_output(found.select(ID, "water_predicted", width.alias("width")))


def q_nrt_arima_ml(spark, sf_dir):
    """NRT rows with forecasts by maximum likelihood, moving-average terms and unit-root tests."""
    prepared = _kernel_prepared(spark, sf_dir)
    return round_output(nrt_breaks(prepared, DW, NRT_DATE, forecast="arima_ml", orders={"max_p": 1, "max_q": 1}))


def q_bayes_trend_breaks(spark, sf_dir):
    """The most probable change of each lake among levels and lines."""
    from ..operators.bayes import bayes_breaks
    found = bayes_breaks(_kernel_prepared(spark, sf_dir), DW, min_sep=3, max_order=1)
    return round_output(found.filter("break_number = 1").drop("proba", "break_number"))


QUERIES = {
    "grid_cells": q_grid_cells,
    "consolidated_months": q_consolidated_months,
    "request_windows": q_request_windows,
    "clipped_change": q_clipped_change,
    "usable_polygons": q_usable_polygons,
    "site_values": q_site_values,
    "panel_keys": q_panel_keys,
    "described_panel": q_described_panel,
    "geojson_written": q_geojson_written,
    "best_scene_of_pixels": q_best_scene_of_pixels,
    "forecast_lines": q_forecast_lines,
    "nrt_arima_ml": q_nrt_arima_ml,
    "bayes_trend_breaks": q_bayes_trend_breaks,
    "lakes_in_box": q_lakes_in_box,
    "historical_run": q_historical_run,
    "lake_point_reads": q_lake_point_reads,
    "panel_io": q_panel_io,
    "lake_lookup": q_lake_lookup,
    "date_lists": q_date_lists,
    "row_shares": q_row_shares,
    "break_views": q_break_views,
    "month_view": q_month_view,
    "availability": q_availability,
    "area_tables": q_area_tables,
    "simple_breaks": q_simple_breaks,
    "simple_breaks_mean": lambda s, d: q_simple_breaks(s, d, "mean"),
    "simple_breaks_max": lambda s, d: q_simple_breaks(s, d, "max"),
    "simple_breaks_jrc": q_simple_breaks_jrc,
    "simple_breaks_ship": q_simple_breaks_ship,
    "nrt_ar1": q_nrt,
    "nrt_monthly_period": lambda s, d: q_nrt(s, d, period="monthly"),
    "nrt_keep_nans": lambda s, d: q_nrt(s, d, keep_nans=True),
    "nrt_ship": q_nrt_ship,
    "history_stats": q_history_stats,
    "drained_month": q_drained_month,
    "nrt_range": q_nrt_range,
    "nrt_range_monthly": q_nrt_range_monthly,
    "monthly_counts": q_monthly_counts,
    "counts_matrix": q_counts_matrix,
    "ranked_drained": q_ranked_drained,
    "prepare_panel": q_prepare_panel,
    "mask_panel": q_mask_panel,
    "gap_report": q_gap_report,
    "rolling_median": q_rolling,
    "rolling_mean": lambda s, d: q_rolling(s, d, "mean"),
    "rolling_max": lambda s, d: q_rolling(s, d, "max"),
    "merge_both": q_merge,
    "merge_date": lambda s, d: q_merge(s, d, "date"),
    "merge_id": lambda s, d: q_merge(s, d, "id_geohash"),
    "to_long": q_to_long,
    "relative_percent": q_relative_percent,
    "compare_sources": q_compare_sources,
    "series_with_break": q_series_with_break,
    "square_lakes": q_square_lakes,
    "bbox_filter": q_bbox_filter,
    "grid_counts": q_grid_counts,
    "bounds": q_bounds,
    "bbox_area_km2": q_bbox_area_km2,
    "largest_lakes": q_largest_lakes,
    "lake_at_points": q_lake_at_points,
    "geohash_decode": q_geohash_decode,
    "split_in_chunks": q_split_in_chunks,
    "monthly_mode": q_monthly_mode,
    "range_mode": q_range_mode,
    "class_areas": q_class_areas,
    "class_areas_jrc": q_class_areas_jrc,
    "select_scenes": q_select_scenes,
    "best_scene": q_best_scene,
    "scene_dates": q_scene_dates,
    "nearest_scene": q_nearest_scene,
    "bayes_breaks": q_bayes_breaks,
    "bayes_first_break": q_bayes_first_break,
    "nrt_arima": q_nrt_arima,
    "user_detector": q_user_detector,
    "spatial_chunks": q_spatial_chunks,
    "historical_breaks": q_historical_breaks,
    "gridded_nrt": q_gridded_nrt,
    "clustered_roundtrip": q_clustered_roundtrip,
    "month_files_roundtrip": q_month_files_roundtrip,
    "wkb_roundtrip": q_wkb_roundtrip,
    "geojson_roundtrip": q_geojson_roundtrip,
    "break_files_union": q_break_files_union,
    "nrt_job_rerun": q_nrt_job_rerun,
    "stream_replay": q_stream_replay,
    "geojson_lines": q_geojson_lines,
    "rescale_attach": q_rescale_attach,
    "valid_keys": q_valid_keys,
}
