"""Scalar helpers: rounding, interval text, confidence, clipping, validators, dates, geometry."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshift.functions.geohash import geohash_neighbour_prefixes
from lakeshift.functions.geometry import bounds, drop_z, polar_xy
from lakeshift.functions.numeric import clip_value, drainage_confidence, interval_text, round_even
from lakeshift.functions.validators import is_geohash, is_lat, is_month
from lakeshift.operators.geo import _geohash_text
from lakeshift.operators.pixels import date_window


def _one(spark, expr, schema="x double", rows=((1.0,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("r")).collect()


def test_round_even_matches_numpy(spark):
    vals = [123.135, 0.12345, 2.5, -0.00005, 1.005, 0.285]
    got = [r.r for r in _one(spark, round_even(F.col("x"), 2), rows=[(v,) for v in vals])]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_interval_text_like_python(spark):
    rows = [(0.5, 12.0), (None, 1.0), (12345678.5, -0.001), (1.239, 1e17)]
    got = [r.r for r in _one(spark, interval_text(F.col("a"), F.col("b")), "a double, b double", rows)]
    want = []
    for a, b in rows:
        fa = "nan" if a is None else str(float(np.round(a, 2)))
        fb = "nan" if b is None else str(float(np.round(b, 2)))
        want.append(f"{fa} : {fb}")
    assert got[:3] == want[:3]
    assert got[3].startswith("1.24 : ")


def test_confidence_counts_null_as_false(spark):
    rows = [(-0.3, 0.1, 0.2, 0.5), (None, 0.1, None, 0.05), (0.0, 0.9, 0.5, 0.5)]
    c = drainage_confidence(F.col("r"), F.col("o"), F.col("l"), F.col("m"))
    got = [x.r for x in _one(spark, c, "r double, o double, l double, m double", rows)]
    assert got == [3, 0, 0]


def test_clip_value(spark):
    rows = [(-80.0,), (None,), (float("nan"),), (10.0,)]
    assert [r.r for r in _one(spark, clip_value(F.col("x")), rows=rows)] == [-50.0, 0.0, 0.0, 10.0]


def test_validators(spark):
    rows = [("2024-07", "b7uefy0bvcrc", 66.5), ("2024-7", "bad-id!", 95.0)]
    df = spark.createDataFrame(rows, "m string, g string, lat double")
    r = df.select(is_month(F.col("m")).alias("a"), is_geohash(F.col("g")).alias("b"),
                  is_lat(F.col("lat")).alias("c")).collect()
    assert [tuple(x) for x in r] == [(True, True, True), (False, False, False)]


def test_date_window(spark):
    rows = [(dt.date(2025, 7, 1),)]
    each = _one(spark, date_window(F.col("d"), 10, "each"), "d date", rows)[0].r
    total = _one(spark, date_window(F.col("d"), 10, "total"), "d date", rows)[0].r
    assert (each.start, each.end) == (dt.date(2025, 6, 21), dt.date(2025, 7, 11))
    assert (total.start, total.end) == (dt.date(2025, 6, 26), dt.date(2025, 7, 6))


def test_neighbour_cells_cover_edges(spark):
    lat, lon = 62.0507, -152.588  # near the east edge of its precision-4 cell
    got = _one(spark, geohash_neighbour_prefixes(F.lit(lat), F.lit(lon)))[0].r
    w, h = 360.0 / 1024, 180.0 / 1024
    qlon, qlat = int((lon + 180) // w), int((lat + 90) // h)
    want = {_geohash_text(-90 + (qlat + dj + 0.5) * h, -180 + (qlon + di + 0.5) * w, 4)
            for dj in (-1, 0, 1) for di in (-1, 0, 1)}
    assert set(got) == want and _geohash_text(lat, lon + 0.01, 4) in got


def test_geometry_helpers(spark):
    schema = "rings array<array<array<struct<x:double,y:double,z:double>>>>"
    ring = [{"x": 0.0, "y": 70.0, "z": 5.0}, {"x": 1.0, "y": 70.0, "z": 5.0}, {"x": 0.0, "y": 71.0, "z": 5.0},
            {"x": 0.0, "y": 70.0, "z": 5.0}]
    df = spark.createDataFrame([([[ring]],)], schema)
    r = df.select(bounds(F.col("rings")).alias("b"), drop_z(F.col("rings")).alias("d"),
                  polar_xy(F.lit(0.0), F.lit(90.0)).alias("pole"),
                  polar_xy(F.lit(90.0), F.lit(71.0)).alias("p71")).first()
    assert (r.b.minx, r.b.maxx, r.b.miny, r.b.maxy) == (0.0, 1.0, 70.0, 71.0)
    assert set(r.d[0][0][0].asDict()) == {"x", "y"}
    assert abs(r.pole.x) < 1e-6 and abs(r.pole.y) < 1e-6
    assert r.p71.x == pytest.approx(2_070_000, rel=0.01) and abs(r.p71.y) < 1e-3
