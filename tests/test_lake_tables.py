"""Tables of lakes and result files: pruning by box and id, footers in tasks, the lakes of a run."""
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from lakeshift.operators.geo import BOX, filter_bbox, lake_curve
from lakeshift.plans.historical import historical_breaks, run_historical
from lakeshift.plans.nrt_jobs import month_date
from lakeshift.sinks.writers import cluster_by_key, write_lakes, write_panel
from lakeshift.sources.derived import planted_panel, square_lakes
from lakeshift.sources.footers import parquet_footers, row_groups_holding
from lakeshift.sources.readers import break_file_report, read_break_files, read_lakes, read_panel


@pytest.fixture()
def scratch(spark, tmp_path):
    return str(tmp_path)


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_box_is_pushed_to_the_scan(spark, scratch):
    lakes = square_lakes(spark, SF_MID)
    write_lakes(lakes, f"{scratch}/boxed", rows_per_group=50, n_files=4)
    box = dict(west=-164.5, south=61.0, east=-160.0, north=63.0)
    found = read_lakes(spark, f"{scratch}/boxed", bbox=box)
    plan = plan_of(found)
    assert "GreaterThanOrEqual(maxx,-164.5)" in plan and "LessThanOrEqual(miny,63.0)" in plan
    assert plan.count("ArrowEvalPython") == 1
    want = {r.id_geohash for r in filter_bbox(lakes, **box).collect()}
    assert {r.id_geohash for r in found.collect()} == want and not set(BOX) & set(found.columns)
    # groups of neighbours: few of them meet the box
    groups = parquet_footers(spark, [f"{scratch}/boxed"], key="miny").select(F.explode("row_groups").alias("g"))
    assert groups.count() >= 30
    assert groups.filter("double(g.hi) - double(g.lo) < 2.0").count() >= 0.5 * groups.count()


def test_centroid_kernel_reads_rings_alone(spark):
    lakes = square_lakes(spark, SF_MID)
    plan = plan_of(filter_bbox(lakes, west=-164.0).select("lake_key"))
    kernel = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(kernel) == 1 and "Area_start_ha" not in plan


def test_curve_of_both_hemispheres(spark):
    rows = spark.createDataFrame([(10.0, 65.0), (10.0, -65.0), (10.1, -65.0), (-170.0, -65.0)], "x double, y double")
    north, south, near, far = [r[0] for r in rows.select(lake_curve(F.col("x"), F.col("y"))).collect()]
    assert north < 1 << 32 <= south and south - (1 << 32) == north and abs(near - south) < abs(far - south)


def test_look_up_reads_one_group(spark, scratch):
    lakes = square_lakes(spark, SF_MID)
    cluster_by_key(lakes, f"{scratch}/c", rows_per_group=100, n_files=4)
    footers = parquet_footers(spark, [f"{scratch}/c"], key="id_geohash")
    ids = [r[0] for r in lakes.select("id_geohash").orderBy(F.rand(42)).limit(30).collect()]
    touched = {r.key: r.n_groups for r in row_groups_holding(footers, [*ids, "zzzzzzzzzzzz"]).collect()}
    assert all(touched[i] == 1 for i in ids) and touched["zzzzzzzzzzzz"] == 0
    with open(next(f"{scratch}/c/{f}" for f in os.listdir(f"{scratch}/c") if f.endswith(".parquet")), "rb") as f:
        column = pq.ParquetFile(f).metadata.row_group(0).column(0)
        assert column.path_in_schema == "id_geohash" and column.has_column_index and column.has_offset_index
    one = spark.read.parquet(f"{scratch}/c").filter(F.col("id_geohash") == ids[0])
    assert one.count() == 1 and "PushedFilters: [IsNotNull(id_geohash), EqualTo(id_geohash" in plan_of(one)


def test_month_is_pushed_to_the_scan(spark, scratch):
    write_panel(planted_panel(spark, SF_MID), f"{scratch}/p")
    panel = read_panel(spark, f"{scratch}/p")
    assert str(month_date(panel, "2019-06")) == str(F.lit(__import__("datetime").date(2019, 6, 1)))
    with pytest.raises(ValueError):
        month_date(panel, "2031-01")
    inside = panel.filter((F.col("date") >= F.lit("2019-06-01").cast("date")) & (F.col("year") == 2019))
    assert "(year" in plan_of(inside).split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_run_has_one_set_of_lakes(spark, scratch):
    """Lakes outside the box, outside the panel or without a polygon are not part of a run."""
    box = dict(west=-164.9, east=-164.3)
    lakes = square_lakes(spark, SF_MID, source="supplier").filter("lake_key % 5 <> 0")
    panel = planted_panel(spark, SF_MID).filter("int(substring(id_geohash, 3)) % 4 <> 0")
    keys = {r.lake_key for r in filter_bbox(lakes, **box).collect()}
    want = {f"lk{k:06d}" for k in keys if k % 4}
    both = historical_breaks(panel, lakes, bbox=box)
    assert {r.id_geohash for r in both.collect()} == want
    for all_lakes in (True, False):
        run_historical(panel, lakes, f"{scratch}/h{all_lakes}", bbox=box, all_lakes=all_lakes)
    out = spark.read.parquet(f"{scratch}/hTrue")
    assert {r.id_geohash for r in out.collect()} == want
    broken = {r.id_geohash for r in out.filter("date_break is not null").collect()}
    assert {r.id_geohash for r in spark.read.parquet(f"{scratch}/hFalse").collect()} == broken
    assert historical_breaks(panel, lakes).count() == len({k for k in range(1, 101) if k % 4 and k % 5})


def test_footers_of_many_files(spark, scratch):
    n = 300
    for k in range(n):
        pq.write_table(pa.table({"id_geohash": [f"l{k}"], "v": [k if k % 2 else float(k)]}), f"{scratch}/f{k}.parquet")
    pd.DataFrame({"v": [7]}, index=pd.Index(["i1"], name="id_geohash")).to_parquet(f"{scratch}/index.parquet")
    pq.write_table(pa.table({"v": [1]}), f"{scratch}/idless.parquet")
    pq.write_table(pa.table({"id_geohash": pa.array([], pa.string())}), f"{scratch}/empty.parquet")
    with open(f"{scratch}/broken.parquet", "wb") as f:
        f.write(b"PAR1 no footer")
    named = [f"{scratch}/{x}" for x in os.listdir(scratch)] + [f"{scratch}/missing.parquet"]
    problems = {os.path.basename(r.path): r.problem for r in break_file_report(spark, named).collect() if r.problem}
    assert set(problems) == {"idless.parquet", "empty.parquet", "broken.parquet", "missing.parquet"}
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    with pytest.warns(UserWarning, match="left out"):
        df = read_break_files(spark, named)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)
    assert jobs <= 8  # listing, footers and one schema per group, not one per file
    rows = {r.id_geohash: r.v for r in df.collect()}
    assert len(rows) == n + 1 and rows["i1"] == 7 and rows["l3"] == 3
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        read_break_files(spark, [f"{scratch}/empty.parquet"])


def test_index_named_by_pandas_alone(spark, scratch):
    """An index whose field has another name than the index itself."""
    table = pa.table({"v": [1, 2], "__index_level_0__": ["a", "b"]}).replace_schema_metadata(
        {"pandas": '{"columns": [{"name": "id_geohash", "field_name": "__index_level_0__"}]}'})
    pq.write_table(table, f"{scratch}/x.parquet")
    assert {r.id_geohash for r in read_break_files(spark, [f"{scratch}/x.parquet"]).collect()} == {"a", "b"}


def collection(features, indent=None):
    import json
    return json.dumps({"type": "FeatureCollection", "name": "lakes", "features": features}, indent=indent)


def feature(k, **extra):
    ring = [[k, 60.0], [k + 0.5, 60.0], [k + 0.5, 60.5], [k, 60.5], [k, 60.0]]
    geometry = {"type": "Polygon", "coordinates": [ring]} if k % 2 else {"type": "MultiPolygon", "coordinates": [[ring]]}
    return {"type": "Feature", "properties": {"id_geohash": f"l{k:05d}", "v": k, "note": "a \"quoted\" {brace", **extra},
            "geometry": geometry}


def flat(df):
    return sorted((r.id_geohash, r.v, r.note, r.rings[0][0][1].x) for r in df.collect())


def test_large_collection_is_split_over_tasks(spark, scratch):
    import json
    features = [feature(k) for k in range(4000)]
    with open(f"{scratch}/one.geojson", "w") as f:
        f.write(collection(features))
    with open(f"{scratch}/pretty.geojson", "w") as f:
        f.write(collection(features, indent=1))
    with open(f"{scratch}/lines.geojsonl", "w") as f:
        f.write("\n".join(map(json.dumps, features)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        want = flat(read_lakes(spark, f"{scratch}/lines.geojsonl"))
        assert len(want) == 4000
        for name in ("one", "pretty"):
            found = read_lakes(spark, f"{scratch}/{name}.geojson")
            assert flat(found) == want
            size = os.path.getsize(f"{scratch}/{name}.geojson")
            assert found.rdd.getNumPartitions() >= 8 and size > 8 * 65536
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_collections_that_cannot_be_split(spark, scratch):
    """Another order of members, or the mark inside a property: read as a whole, with the same result."""
    features = [feature(k) for k in range(6)]
    want = flat(read_lakes_of(spark, scratch, "plain", collection(features)))
    turned = [dict(reversed(f.items())) for f in features]
    assert flat(read_lakes_of(spark, scratch, "turned", collection(turned))) == want
    marked = [feature(k, kind="Feature") for k in range(6)]
    assert flat(read_lakes_of(spark, scratch, "marked", collection(marked))) == want
    one = flat(read_lakes_of(spark, scratch, "single", collection(features[:1])))
    assert one == want[:1]


def read_lakes_of(spark, scratch, name, text):
    with open(f"{scratch}/{name}.geojson", "w") as f:
        f.write(text)
    return read_lakes(spark, f"{scratch}/{name}.geojson")
