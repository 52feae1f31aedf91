"""Lakes at points against brute force: sizes, hot cells, edges; nearest scenes over cut lakes."""
import datetime as dt
import random

from pyspark.sql import functions as F

from lakeshift.operators import covering
from lakeshift.operators.covering import lake_at_points
from lakeshift.operators.pixels import nearest_scene

LAKE = "id_geohash string, rings array<array<array<struct<x: double, y: double>>>>"


def square(x, y, side):
    return [[[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]]


def brute(points, lakes):
    out = []
    for key, lat, lon in points:
        inside = [i for i, x, y, s in lakes if lat is not None and lon is not None
                  and x < lon < x + s and y < lat < y + s]
        out.append((key, min(inside, default=None)))
    return sorted(out)


def check(spark, points, lakes):
    got = lake_at_points(spark.createDataFrame(points, "point_id long, lat double, lon double"),
                         spark.createDataFrame([(i, square(x, y, s)) for i, x, y, s in lakes], LAKE))
    assert sorted(map(tuple, got.collect())) == brute(points, lakes)


def test_lakes_of_all_sizes(spark):
    rng = random.Random(1)
    lakes = [(f"l{k:03d}", rng.uniform(-180, 170), rng.uniform(-80, 80), rng.choice([0.003, 0.05, 0.4, 3.0, 25.0, 120.0]))
             for k in range(80)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)]
    points += [(1000 + k, y + rng.uniform(-0.2, 1.2) * s, x + rng.uniform(-0.2, 1.2) * s) for k, (_, x, y, s) in enumerate(lakes)]
    check(spark, points + [(5000, None, 1.0), (5001, 1.0, None)], lakes)


def test_far_coordinates_and_no_lakes(spark):
    lakes = [("a", -5000.0, 10.0, 2.0), ("b", 1.0e9, 1.0e9, 50.0), ("c", 0.0, 0.0, 1.0e7)]
    check(spark, [(1, 11.0, -4999.0), (2, 1.0e9 + 5, 1.0e9 + 5), (3, 5.0, 5.0e6), (4, -1.0, 0.0)], lakes)
    check(spark, [(1, 11.0, 1.0)], [])


def test_third_of_all_lakes_in_one_coarse_cell(spark):
    # small lakes crowd one area the size of a four-character geohash cell, far more than any other
    rng = random.Random(2)
    lakes = [(f"d{k:04d}", 10 + 0.005 * (k % 60), 60 + 0.005 * (k // 60), 0.004) for k in range(600)]
    lakes += [(f"e{k:04d}", rng.uniform(-170, 170), rng.uniform(-70, 70), 0.004) for k in range(1200)]
    points = [(k, 60 + rng.uniform(0, 0.05), 10 + rng.uniform(0, 0.3)) for k in range(400)]
    check(spark, points, lakes)
    boxed = covering.covering(covering.with_box(
        spark.createDataFrame([(i, square(x, y, s)) for i, x, y, s in lakes], LAKE)))
    fullest = boxed.select(F.explode("cells").alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert fullest <= 20 and boxed.agg(F.max(F.size("cells"))).first()[0] <= 4


def test_hot_cell_is_split(spark):
    # a third of all points in one lake
    rng = random.Random(3)
    lakes = [("hot", 20.0, 65.0, 0.008)] + [(f"l{k}", 21 + 0.02 * k, 66.0, 0.008) for k in range(50)]
    points = spark.range(40_000).select(
        F.col("id").alias("point_id"),
        F.when(F.col("id") % 3 == 0, F.lit(65.004)).otherwise(66.004).alias("lat"),
        F.when(F.col("id") % 3 == 0, F.lit(20.004)).otherwise(21.004 + 0.02 * (F.col("id") % 50)).alias("lon"))
    found = lake_at_points(points, spark.createDataFrame([(i, square(x, y, s)) for i, x, y, s in lakes], LAKE))
    rows = {r.id_geohash: r["count"] for r in found.groupBy("id_geohash").count().collect()}
    assert rows["hot"] == 13334 and sum(rows.values()) == 40_000 and None not in rows
    probes = points.select(covering.cell_key(F.lit(0), covering.cell_number(F.lit(0.01), F.col("lon")),
                                             covering.cell_number(F.lit(0.01), F.col("lat"))).alias("cell"))
    split = covering.hot_cells(probes, 16)
    assert len(split) == 1 and 5 <= list(split.values())[0] <= 6


def brute_nearest(requests, scenes):
    out = []
    for key, lake, at in requests:
        near = [(abs((t - at).total_seconds()), t, s) for i, s, t in scenes if lake is not None and i == lake and t and at]
        best = min(near, default=(None, None, None))
        out.append((key, lake, at, best[2], best[1]))
    return sorted(out, key=repr)


def test_nearest_scene_over_cut_lakes(spark):
    rng = random.Random(4)
    day = dt.datetime(2024, 1, 5)
    # a third of all scenes on one day of one lake, many of them at one instant
    scenes = [("hot", f"h{k}", day + dt.timedelta(seconds=rng.choice([7, rng.randrange(86400)]))) for k in range(300)]
    scenes += [(f"p{rng.randrange(20)}", f"s{k}", day + dt.timedelta(minutes=rng.randrange(-40000, 40000))) for k in range(600)]
    scenes += [("p1", "none", None), (None, "lost", day)]
    requests = [(k, rng.choice(["hot", "hot", f"p{rng.randrange(25)}"]),
                 day + dt.timedelta(seconds=rng.choice([7, rng.randrange(-90000, 200000)]))) for k in range(300)]
    requests += [(400 + k, "hot", day + dt.timedelta(seconds=100)) for k in range(100)]
    requests += [(900, None, day), (901, "hot", None), (902, "nowhere", day)]
    got = nearest_scene(spark.createDataFrame(requests, "request_id long, id_geohash string, at timestamp"),
                        spark.createDataFrame(scenes, "id_geohash string, scene_id string, time timestamp"), partitions=13)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_nearest(requests, scenes)
    empty = spark.createDataFrame([], "id_geohash string, scene_id string, time timestamp")
    asked = spark.createDataFrame(requests, "request_id long, id_geohash string, at timestamp")
    assert nearest_scene(asked, empty).filter("scene_id is not null").count() == 0
