"""Bayesian change points, forecasts, pixels and the as-of scene join."""
import numpy as np
import pytest

from conftest import SF_MID, SF_SMALL
from lakeshift.family import DW
from lakeshift.operators.bayes import bayes_breaks, changepoint_probability
from lakeshift.operators.forecast import arima_one_step
from lakeshift.operators.panel import prepare
from lakeshift.operators.pixels import monthly_mode, nearest_scene
from lakeshift.plans.catalog import scene_requests
from lakeshift.sources.derived import planted_panel, scene_table


def test_kernel_finds_a_drop():
    x = np.r_[np.full(12, 0.8), np.full(12, 0.3)] + np.tile([0.0, 0.01], 12)
    p = changepoint_probability(x)
    assert p.argmax() == 12 and p[12] > 0.9
    assert (np.delete(p, 12) < 0.2).all()


def test_kernel_stable_series_has_no_break():
    x = 0.8 + 0.005 * (np.arange(40) % 5)
    assert changepoint_probability(x).max() < 0.5


def test_planted_lakes(spark):
    out = bayes_breaks(prepare(planted_panel(spark, SF_MID), DW), DW)
    lakes = {r.id_geohash for r in out.filter("break_number = 1").collect()}
    planted = {f"lk{k:06d}" for k in range(100) if k % 3 == 0}
    assert lakes == planted
    assert out.filter("proba <= 0.5").count() == 0


def test_arima_kernel():
    pred, lo, hi, how = arima_one_step(np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0]))
    assert pred == pytest.approx(7.0, abs=1e-6) and lo <= pred <= hi
    pred, lo, hi, how = arima_one_step(np.array([0.5, 0.5, 0.5]))
    assert (pred, lo, hi) == (0.5, 0.5, 0.5)


def test_mode_ties_to_smallest_label(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", 3, 1.0), ("a", 1, "2024-01-02 00:00:00", 2, 1.0),
            ("a", 1, "2024-01-03 00:00:00", 3, 1.0), ("a", 1, "2024-01-04 00:00:00", 2, 1.0)]
    df = spark.createDataFrame(rows, "id_geohash string, pixel_id long, ts string, label int, pixel_area_m2 double")
    df = df.withColumn("ts", df.ts.cast("timestamp"))
    assert monthly_mode(df).first().label_mode == 2


def test_nearest_scene_brute_force(spark):
    req = scene_requests(spark, SF_SMALL)
    sc = scene_table(spark, SF_SMALL)
    got = {r.request_id: r.scene_id for r in nearest_scene(req, sc, partitions=7).collect()}
    scenes = sc.collect()
    for r in req.limit(200).collect():
        cands = [(abs((s.time - r["at"]).total_seconds()), s.time, s.scene_id) for s in scenes
                 if s.id_geohash == r.id_geohash]
        assert got[r.request_id] == (min(cands)[2] if cands else None)
