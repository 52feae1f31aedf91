"""Readers, writers, date lists, resume and consolidation."""
import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from lakeshift.family import DW
from lakeshift.operators.geo import lonlat_grid
from lakeshift.plans.historical import run_historical
from lakeshift.plans.nrt_jobs import consolidate, run_nrt_range
from lakeshift.session import checkpoint_dir
from lakeshift.sinks.writers import describe_columns, write_geojsonseq, write_panel
from lakeshift.sources.derived import planted_panel, square_lakes
from lakeshift.sources.readers import (dates_from_options, read_break_files, read_lakes, read_panel,
                                       stepped_dates)
from lakeshift.functions.validators import valid_years


@pytest.fixture()
def scratch(spark):
    return f"{checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


def test_panel_roundtrip_parquet_and_csv(spark, scratch):
    p = planted_panel(spark, SF_SMALL)
    write_panel(p, f"{scratch}/panel")
    back = read_panel(spark, f"{scratch}/panel").drop("year")
    assert back.count() == p.count()
    nan_row = p.limit(1).withColumn("water", F.lit(float("nan")))
    nan_row.write.option("header", "true").csv(f"{scratch}/nan.csv")
    got = read_panel(spark, f"{scratch}/nan.csv", fmt="csv").first()
    assert got.water is None and isinstance(got.date, dt.date)


def test_geojson_lines_read_back(spark, scratch):
    lakes = square_lakes(spark, SF_SMALL)
    write_geojsonseq(lakes, f"{scratch}/lakes", points=True)
    back = read_lakes(spark, f"{scratch}/lakes", fmt="json")
    assert back.count() == lakes.count()
    a = {r.id_geohash: r.Area_start_ha for r in lakes.collect()}
    b = {r.id_geohash: r.Area_start_ha for r in back.collect()}
    assert a == b
    pts = spark.read.json(f"{scratch}/lakes_points")
    assert pts.filter(F.col("geometry.type") == "Point").count() == lakes.count()


def test_break_files_skip_bad(spark, scratch):
    spark.range(3).withColumnRenamed("id", "id_geohash").write.parquet(f"{scratch}/a")
    spark.range(2).withColumnRenamed("id", "other").write.parquet(f"{scratch}/b")
    os.makedirs(f"{scratch}/c")
    with open(f"{scratch}/c/broken.parquet", "w") as fh:
        fh.write("not parquet")
    df = read_break_files(spark, [f"{scratch}/a", f"{scratch}/b", f"{scratch}/c/broken.parquet"])
    assert df.count() == 3
    with pytest.raises(FileNotFoundError):
        read_break_files(spark, [f"{scratch}/b"])


def test_metadata(spark):
    df = describe_columns(planted_panel(spark, SF_SMALL), DW)
    meta = {f.name: f.metadata for f in df.schema.fields}
    assert meta["water"]["unit"] == "ha" and "id_geohash" not in [k for k, v in meta.items() if v]


def test_date_lists(spark):
    assert dates_from_options(spark, years=[2020, 2021], months=[6, 7]).count() == 4
    with pytest.raises(ValueError):
        dates_from_options(spark, years=[2020], months=[6], date_list=["2020-06-01"])
    with pytest.raises(ValueError):
        dates_from_options(spark, date_list=[])
    d = [r.date for r in stepped_dates(spark, "2025-06-04", 7, count=3).collect()]
    assert d == [dt.date(2025, 6, 4), dt.date(2025, 6, 11), dt.date(2025, 6, 18)]
    assert valid_years([2015, 2016, "x"], "dw") == [2016]
    assert valid_years(None, "jrc") == list(range(1984, 2022))
    assert lonlat_grid(spark, (-180.0, -160.0), (60.0, 64.0), 10.0, 2.0).count() == 4


def test_resume_and_consolidate(spark, scratch):
    panel = planted_panel(spark, SF_MID)
    c1 = run_nrt_range(panel, "2019-01", "2019-06", scratch, DW)
    assert c1.count() == 6
    c2 = run_nrt_range(panel, "2019-01", "2019-08", scratch, DW)  # only July and August are new
    months = sorted(r.analysis_month for r in c2.collect())
    assert months == [f"2019-{m:02d}" for m in range(1, 9)]
    breaks, counts = consolidate(scratch, spark)
    per_month = {r.analysis_month: r["count"] for r in breaks.groupBy("analysis_month").count().collect()}
    for r in counts.collect():
        assert per_month.get(r.analysis_month, 0) == r.drained_lake_count


def test_historical_run_writes(spark, scratch):
    lakes = square_lakes(spark, SF_MID, source="supplier")
    run_historical(planted_panel(spark, SF_MID), lakes, f"{scratch}/hist", bbox={"west": -164.9, "east": -164.3})
    out = spark.read.parquet(f"{scratch}/hist")
    assert out.count() == 20 and "rings" in out.columns
