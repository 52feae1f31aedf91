"""Geometry, geohash, box filter, point lookup, chunks, clustered layout."""
import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from lakeshift.functions.geohash import decode_arrays, encode_arrays, geohash_decode, geohash_encode
from lakeshift.functions.geometry import centroid, contains, polygon_area
from lakeshift.operators.geo import (_geohash_text, check_bbox, filter_bbox, lake_at_point, split_in_chunks)
from lakeshift.session import checkpoint_dir
from lakeshift.sinks.writers import cluster_by_key
from lakeshift.sources.derived import square_lakes


def test_bbox_validation():
    with pytest.raises(ValueError):
        check_bbox()
    with pytest.raises(ValueError):
        check_bbox(west=1, east=0)
    with pytest.raises(ValueError):
        check_bbox(south=2, north=1)


def test_partial_bounds(spark):
    lakes = square_lakes(spark, SF_MID)
    n_all = lakes.count()
    west_only = filter_bbox(lakes, west=-160.0).count()
    east_only = filter_bbox(lakes, east=-160.0).count()
    assert west_only + east_only == n_all  # no centroid exactly on -160


def test_geohash_matches_bisection():
    rng = np.random.default_rng(42)
    lat, lon = rng.uniform(-89, 89, 500), rng.uniform(-179, 179, 500)
    got = encode_arrays(lat, lon, 12)
    assert list(got) == [_geohash_text(a, b, 12) for a, b in zip(lat, lon)]
    dlat, dlon = decode_arrays(__import__("pandas").Series(got))
    assert np.abs(dlat - lat).max() < 1e-6 and np.abs(dlon - lon).max() < 1e-6


def test_geohash_roundtrip_spark(spark):
    df = spark.createDataFrame([(66.52, -164.1), (0.0, 0.0)], "lat double, lon double")
    gh = df.select(geohash_encode(F.col("lat"), F.col("lon"), 9).alias("g"))
    back = gh.select("g", geohash_decode(F.col("g")).alias("d")).collect()
    assert back[0].g == _geohash_text(66.52, -164.1, 9)
    assert abs(back[0].d.lat - 66.52) < 1e-3


def test_polygon_with_hole(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    shell = ring([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    hole = ring([(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)])
    df = spark.createDataFrame([([[shell, hole]],)], "rings array<array<array<struct<x:double,y:double>>>>")
    r = df.select(polygon_area(F.col("rings")).alias("a"), centroid(F.col("rings")).alias("c"),
                  contains(F.col("rings"), F.lit(1.5), F.lit(1.5)).alias("in_hole"),
                  contains(F.col("rings"), F.lit(3.0), F.lit(3.0)).alias("inside"),
                  contains(F.col("rings"), F.lit(5.0), F.lit(3.0)).alias("outside")).first()
    assert r.a == pytest.approx(15.0) and r.c.x == pytest.approx((32 - 1.5) / 15)
    assert (r.in_hole, r.inside, r.outside) == (False, True, False)


def test_single_point_lookup(spark):
    lakes = square_lakes(spark, SF_SMALL)
    first = lakes.orderBy("lake_key").first()
    lon0 = first.rings[0][0][0].x + 0.002
    lat0 = first.rings[0][0][0].y + 0.002
    assert lake_at_point(lakes, lat0, lon0).first().id_geohash == first.id_geohash
    assert lake_at_point(lakes, lat0 + 0.01, lon0).count() == 0


def test_chunks_are_dense(spark):
    lakes = square_lakes(spark, SF_MID).select("id_geohash")
    rows = split_in_chunks(lakes, 100, n_ranges=7).orderBy("id_geohash").collect()
    assert [r.chunk for r in rows] == [i // 100 + 1 for i in range(len(rows))]


def test_clustered_layout(spark):
    lakes = square_lakes(spark, SF_MID)
    out = f"{checkpoint_dir(spark)}/test-clustered"
    cluster_by_key(lakes, out, rows_per_group=100, n_files=4)
    files = sorted(glob.glob(f"{out}/*.parquet"))
    groups, ids = 0, []
    for f in files:
        md = pq.ParquetFile(f).metadata
        groups += md.num_row_groups
        ids += pq.read_table(f, columns=["id_geohash"]).column(0).to_pylist()
    assert ids == sorted(ids) and len(ids) == lakes.count()
    assert groups >= len(ids) // 100
    # a key lookup touches at most one or two row groups
    stats = []
    for f in files:
        md = pq.ParquetFile(f).metadata
        for g in range(md.num_row_groups):
            s = md.row_group(g).column(0).statistics
            stats.append((s.min, s.max))
    rng = np.random.default_rng(42)
    touched = [sum(1 for lo, hi in stats if lo <= k <= hi) for k in rng.choice(ids, 30)]
    assert np.mean(touched) <= 1.5
    with pytest.raises(ValueError):
        cluster_by_key(lakes, out, in_path=out)
    with pytest.raises(ValueError):
        cluster_by_key(lakes, out + "x", key="nope")


def test_spatial_chunks_bounded(spark):
    from lakeshift.operators.geo import spatial_chunks
    out = spatial_chunks(square_lakes(spark, SF_SMALL), size=20)
    sizes = [r["count"] for r in out.groupBy("chunk").count().collect()]
    assert sum(sizes) == 150 and max(sizes) <= 20


def test_dense_position_in_groups(spark):
    from lakeshift.operators.ordering import dense_position
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"))
    rows = dense_position(df, ["g"], ["id"], "pos", partitions=7).collect()
    for g in range(3):
        ids = sorted(r.id for r in rows if r.g == g)
        pos = {r.id: r.pos for r in rows if r.g == g}
        assert [pos[i] for i in ids] == list(range(1, len(ids) + 1))
