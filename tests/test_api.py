"""Smaller API pieces: panel filters, views, ids, geometry helpers, lineage cut."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from lakeshift.family import DW
from lakeshift.functions.geohash import geohash_from_label, geohash_label
from lakeshift.operators.geo import attach_geometry, filter_valid_geometry, total_bounds
from lakeshift.operators.panel import (area_sum, availability, filter_ids, normalize_rows, object_ids, prepare,
                                       resolve_analysis_date, same_month_history, site_series, split_at,
                                       valid_lakes_at)
from lakeshift.operators.pixels import areas_to_panel, class_areas_dw, range_mode
from lakeshift.operators.stats import lake_max_area
from lakeshift.operators.views import (hide_stable, largest_lakes, month_parts, pick_month, pick_variables,
                                       to_long)
from lakeshift.session import cut_lineage
from lakeshift.sources.derived import pixel_table, planted_panel, square_lakes
from lakeshift.sources.readers import annual_dates, read_lake, read_lakes_in


def test_panel_filters(spark):
    p = planted_panel(spark, SF_SMALL)
    at, before = split_at(p, "2019-06-01")
    assert at.count() == 10 and before.filter(F.col("date") >= dt.date(2019, 6, 1)).count() == 0
    assert same_month_history(p, 6).select(F.month("date")).distinct().count() == 1
    assert resolve_analysis_date(p, "2019-06").first().date == dt.date(2019, 6, 1)
    assert resolve_analysis_date(p, "2031-01").count() == 0
    prepared = prepare(p, DW)
    flags = valid_lakes_at(prepared, "2019-06-01", ["water_norm", "bare_norm"]).collect()
    assert len(flags) == 10 and any(f.is_valid for f in flags)


def test_ids_and_availability(spark):
    p = planted_panel(spark, SF_SMALL)
    ids = spark.createDataFrame([("lk000001",), ("lk999999",)], "id_geohash string")
    kept, missing = filter_ids(p, ids)
    assert kept.select("id_geohash").distinct().count() == 1
    assert [r.id_geohash for r in missing.collect()] == ["lk999999"]
    av = {r.id_geohash: r.available for r in availability(p, ids).collect()}
    assert av == {"lk000001": True, "lk999999": False}
    assert object_ids(p).count() == 10


def test_site_series_and_rows(spark):
    prepared = prepare(planted_panel(spark, SF_SMALL), DW)
    one = site_series(prepared, "lk000001", ["water", "area_nodata"])
    assert one.count() == prepared.filter("id_geohash = 'lk000001' and valid").count()
    rows = normalize_rows(prepared.select("id_geohash", "date", "water", "area_data", "area_nodata"))
    rows = rows.filter(F.col("water").isNotNull())
    assert rows.agg(F.max("water")).first()[0] <= 1.0
    assert lake_max_area(prepared).count() == 10
    total = planted_panel(spark, SF_SMALL).select(area_sum(DW).alias("t")).agg(F.min("t")).first()[0]
    assert total > 0


def test_views(spark):
    long = to_long(planted_panel(spark, SF_SMALL))
    assert pick_variables(long, ["water"]).select("variable").distinct().count() == 1
    counts = spark.createDataFrame([("2019-06", 3), ("2019-07", 0)], "analysis_month string, n int")
    mp = month_parts(counts).collect()
    assert (mp[0].year, mp[0].month) == (2019, 6)
    assert pick_month(counts, "2019-07").count() == 1
    br = spark.createDataFrame([("a", 2019), ("b", None)], "id_geohash string, date_break_year int")
    assert hide_stable(br).count() == 1
    nrt = spark.createDataFrame([("a", 0), ("b", None), ("c", 2)], "id_geohash string, drainage_confidence int")
    assert hide_stable(nrt, view="nrt").count() == 1


def test_lake_helpers(spark):
    lakes = square_lakes(spark, SF_SMALL)
    assert filter_valid_geometry(lakes).count() == 150
    top = largest_lakes(lakes, n=5).collect()
    assert len(top) == 5 and top[0].Area_start_ha == max(r.Area_start_ha for r in lakes.collect())
    b = total_bounds(lakes).first()
    assert b.minx < b.center_x < b.maxx
    one = lakes.first().id_geohash
    assert read_lake(lakes, one).count() == 1
    ids = lakes.limit(3).select("id_geohash")
    assert read_lakes_in(lakes, ids).count() == 3
    breaks = spark.createDataFrame([(one, 2020)], "id_geohash string, date_break_year int")
    assert attach_geometry(breaks, lakes, "left").count() == 150
    assert attach_geometry(breaks, lakes, "inner").count() == 1
    lab = lakes.select(geohash_label(F.col("id_geohash")).alias("l")).first().l
    assert lakes.select(geohash_from_label(F.lit(lab)).alias("g")).first().g in lab


def test_pixels_to_panel(spark):
    px = pixel_table(spark, SF_SMALL)
    modes = range_mode(px, year=2024, month=1)
    panel = areas_to_panel(class_areas_dw(modes), class_areas_dw(modes.withColumn("date", F.lit("2024-02-01"))))
    assert panel.select("date").distinct().count() == 2
    prepared = prepare(panel, DW)
    assert prepared.count() == panel.count()
    assert [r.date for r in annual_dates(spark, years=[2001, 2000]).collect()] == [dt.date(2000, 1, 1),
                                                                                  dt.date(2001, 1, 1)]


def test_cut_lineage(spark):
    df = prepare(planted_panel(spark, SF_MID), DW).filter("valid")
    cut = cut_lineage(df)
    assert cut.count() == 5261
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()
