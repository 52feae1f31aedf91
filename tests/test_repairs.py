"""Cases that small test data cannot show: many rows, long keys, odd input files, repeated jobs."""
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lakeshift.family import DW
from lakeshift.functions import wkb
from lakeshift.functions.geohash import geohash_decode, geohash_encode
from lakeshift.operators.breaks import all_breaks
from lakeshift.operators.nrt import parse_analysis_date
from lakeshift.operators.ordering import dense_position
from lakeshift.operators.panel import filter_ids, gap_report
from lakeshift.operators.pixels import class_areas_jrc
from lakeshift.operators.views import series_with_break
from lakeshift.plans.nrt_jobs import run_nrt_range
from lakeshift.session import checkpoint_dir
from lakeshift.sinks.writers import write_nrt_month
from lakeshift.sources.derived import padded, planted_panel, square_corner
from lakeshift.sources.readers import annual_dates, read_break_files, read_lakes, read_nrt_results
from lakeshift.streaming.monthly_stream import process_batch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def scratch(spark):
    return f"{checkpoint_dir(spark)}/repairs-{uuid.uuid4().hex}"


def test_dense_position_on_many_rows_with_extra_columns(spark):
    n = 500_000
    df = (spark.range(0, n, 1, 8).withColumn("g", F.col("id") % 3).withColumn("key", F.xxhash64("id"))
          .withColumn("extra", F.repeat(F.lit("x"), 20)).withColumn("more", F.col("id") * 2))
    got = dense_position(df, ["g"], ["key"], "pos")
    per_group = got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"),
                                     F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()
    assert sum(r.n for r in per_group) == n
    assert all(r.n == r.d == r.hi and r.lo == 1 for r in per_group)
    whole = dense_position(df, [], ["key"], "pos").agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).first()
    assert tuple(whole) == (n, n, n)


def test_keys_are_never_cut(spark):
    keys = spark.range(999_990, 1_000_110).select(padded(F.col("id")).alias("k"))
    assert keys.distinct().count() == 120
    assert spark.range(1).select(padded(F.lit(7)).alias("k")).first().k == "000007"


def test_square_corners_stay_apart_and_on_the_globe(spark):
    x, y = square_corner(F.col("id"))
    rows = spark.range(1, 150_001).select(x.alias("x"), y.alias("y"))
    ids = rows.select(geohash_encode(F.col("y") + 0.002, F.col("x") + 0.002, 12).alias("g"))
    assert ids.filter("g is not null").distinct().count() == 150_000
    assert rows.filter("abs(x) > 180 or abs(y) > 90").count() == 0


def test_geohash_out_of_range_is_null(spark):
    df = spark.createDataFrame([(91.0, 0.0), (0.0, 181.0), (10.0, 10.0)], "lat double, lon double")
    got = [r[0] for r in df.select(geohash_encode(F.col("lat"), F.col("lon"), 12)).collect()]
    assert got[:2] == [None, None] and got[2]
    long = spark.createDataFrame([("b7uefy0bvcrcZZZ",), ("b7uefy0bvcrc",)], "g string")
    lats = [r[0]["lat"] for r in long.select(geohash_decode(F.col("g"))).collect()]
    assert lats[0] is None and lats[1] is not None


def test_unknown_pixel_codes_count_in_no_class(spark):
    px = spark.createDataFrame([("a", 1, "2020-05-01 00:00:00", 6, 10000.0), ("a", 2, "2020-05-01 00:00:00", 3, 10000.0)],
                               "id_geohash string, pixel_id long, ts string, label int, pixel_area_m2 double")
    row = class_areas_jrc(px.withColumn("ts", F.col("ts").cast("timestamp"))).first()
    assert (row.area_land, row.area_water_seasonal, row.area_water_permanent) == (0.0, 0.0, 1.0)


def test_analysis_date_forms():
    assert {parse_analysis_date(t) for t in ("2019-06", "June 2019", "2019/06/01", "20190601")} == {"2019-06-01"}
    with pytest.raises(ValueError):
        parse_analysis_date("no date")


def test_unmasked_detector_skips_incomplete_rows(spark):
    months = [f"{2017 + i // 12}-{i % 12 + 1:02d}-01" for i in range(36)]
    rows = [("a", m, None if i in (27, 28) else (8.0 if i < 27 else 2.0), 2.0 if i < 27 else 8.0)
            for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "id_geohash string, date string, water double, bare double")
    zero = [F.lit(0.0).alias(c) for c in DW.classes if c not in ("water", "bare")]
    panel = df.select("id_geohash", F.col("date").cast("date").alias("date"), "water", "bare", *zero)
    got = [r.date_break.isoformat() for r in all_breaks(panel, "simple", DW, mask=False).collect()]
    assert got == ["2019-06-01"]


def square(x, y):
    return [[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]


def test_geojson_of_mixed_types_and_collections(spark, scratch):
    features = [
        {"type": "Feature", "properties": {"id_geohash": "a", "v": 1}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0)]}},
        {"type": "Feature", "properties": {"id_geohash": "b", "v": 2},
         "geometry": {"type": "MultiPolygon", "coordinates": [[square(5, 5)], [square(9, 9)]]}},
        {"type": "Feature", "properties": {"id_geohash": "c", "v": None}, "geometry": None}]
    lines = spark.createDataFrame([(json.dumps(f),) for f in features], "value string")
    lines.coalesce(1).write.text(f"{scratch}/lines")
    got = {r.id_geohash: len(r.rings) for r in read_lakes(spark, f"{scratch}/lines", fmt="json").collect()}
    assert got == {"a": 1, "b": 2}
    whole = json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{scratch}/whole")
    got = {r.id_geohash: len(r.rings) for r in read_lakes(spark, f"{scratch}/whole", fmt="json").collect()}
    assert got == {"a": 1, "b": 2}
    bad = spark.createDataFrame([('{"type":"Feature","properties":{"id_geohash":"x"},"geometry":'
                                  '{"type":"Point","coordinates":[1,2]}}',)], "value string")
    bad.write.text(f"{scratch}/bad")
    with pytest.raises(Exception, match="no polygon"):
        read_lakes(spark, f"{scratch}/bad", fmt="json").collect()


def test_wkb_round_trip():
    one = [[[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}, {"x": 0.0, "y": 1.0}], [{"x": 0.5, "y": 0.5}] * 4]]
    assert wkb.decode(wkb.encode(one)) == one
    assert wkb.decode(wkb.encode(one * 2)) == one * 2
    with pytest.raises(ValueError):
        wkb.decode(b"\x01\x01\x00\x00\x00" + bytes(16))


def test_break_files_of_other_types_keep_all_rows(spark, scratch):
    spark.sql("select 'a' id_geohash, 1 v").write.parquet(f"{scratch}/a")
    spark.sql("select 'b' id_geohash, 2.5D v").write.parquet(f"{scratch}/b")
    spark.sql("select 'c' id_geohash, 'x' w").write.parquet(f"{scratch}/c")
    got = {r.id_geohash: (r.v, r.w) for r in read_break_files(spark, [f"{scratch}/{x}" for x in "abc"]).collect()}
    assert got == {"a": (1.0, None), "b": (2.5, None), "c": (None, "x")}


def test_empty_month_is_written_and_replaces_rows(spark, scratch):
    df = spark.createDataFrame([("2017-01", "a", 1.0)], "analysis_month string, id_geohash string, v double")
    write_nrt_month(df, scratch, ["2017-01", "2017-02"])
    assert read_nrt_results(spark, scratch).count() == 1
    write_nrt_month(df.limit(0), scratch, ["2017-01", "2017-02"])
    assert read_nrt_results(spark, scratch).count() == 0


def test_range_job_repeats_without_doubling(spark, scratch):
    panel = planted_panel(spark, SF)
    first = {tuple(r) for r in run_nrt_range(panel, "2019-05", "2019-07", scratch, DW).collect()}
    again = [tuple(r) for r in run_nrt_range(panel, "2019-05", "2019-07", scratch, DW, resume=False).collect()]
    assert len(again) == 3 and set(again) == first
    run_nrt_range(panel, "2019-05", "2019-07", scratch, DW, threshold=-5.0, resume=False)
    assert spark.read.parquet(f"{scratch}/breaks").count() == 0


def test_resume_reads_only_pending_months(spark, scratch, monkeypatch):
    from lakeshift.plans import nrt_jobs
    panel = planted_panel(spark, SF)
    run_nrt_range(panel, "2019-05", "2019-06", scratch, DW)
    asked = []
    real = nrt_jobs.drained_or_failed
    monkeypatch.setattr(nrt_jobs, "drained_or_failed", lambda p, months, *a: asked.append((months[0], months[-1])) or real(p, months, *a))
    run_nrt_range(panel, "2019-05", "2019-07", scratch, DW)
    run_nrt_range(panel, "2019-05", "2019-07", scratch, DW)
    assert asked == [("2019-07", "2019-07")]


def test_batch_delivered_twice(spark, scratch):
    panel = planted_panel(spark, SF)
    month = F.date_format("date", "yyyy-MM")
    panel.filter(month < "2019-06").write.parquet(f"{scratch}/history")
    for _ in range(2):
        process_batch(panel.filter(month == "2019-06"), f"{scratch}/history", f"{scratch}/out", DW, batch_id=3)
    assert spark.read.parquet(f"{scratch}/out/counts").count() == 1
    breaks = spark.read.parquet(f"{scratch}/out/breaks")
    assert breaks.count() == breaks.select("id_geohash").distinct().count()


def test_filter_ids_rules(spark):
    panel = planted_panel(spark, SF).limit(60)
    some = spark.createDataFrame([("lk000001",), ("nope",)], "id_geohash string")
    with pytest.warns(UserWarning):
        filter_ids(planted_panel(spark, SF), some)
    with pytest.raises(ValueError):
        filter_ids(planted_panel(spark, SF), some, "error")
    with pytest.raises(ValueError):
        filter_ids(panel, some.filter("id_geohash = 'nope'"))


def test_small_options(spark):
    with pytest.raises(ValueError):
        annual_dates(spark, years=[2001], date_list=["2001-01-01"])
    panel = planted_panel(spark, SF)
    row = series_with_break(panel.select("id_geohash", "date"), break_date="2019-06-01").first()
    assert row.first_break.isoformat() == "2019-06-01"
    ids = panel.select("id_geohash").distinct().limit(2)
    assert gap_report(panel, threshold=101.0, ids=ids).count() == 2
