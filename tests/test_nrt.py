"""NRT detector: column order, confidence, absolute values, month jobs, counts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from lakeshift.family import DW
from lakeshift.operators.nrt import NRT_COLUMNS, nrt_breaks
from lakeshift.operators.panel import prepare
from lakeshift.plans.nrt_jobs import nrt_month, nrt_range, nrt_range_counts
from lakeshift.sources.derived import planted_panel


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(planted_panel(spark, SF_MID), DW).cache()


def test_column_order(prepared):
    out = nrt_breaks(prepared, DW, "2019-06")
    assert out.columns == ["id_geohash"] + NRT_COLUMNS
    assert len(NRT_COLUMNS) == 24


@pytest.mark.parametrize("when", ["2019-06", "2019-06-01", dt.date(2019, 6, 1)])
def test_date_forms(prepared, when):
    assert nrt_breaks(prepared, DW, when).count() == 88


def test_confidence_and_absolute(prepared):
    rows = nrt_breaks(prepared, DW, "2019-06").collect()
    for r in rows:
        assert 0 <= r.drainage_confidence <= 3
        if r.water_observed:
            assert r.water_observed_absolute >= r.water_observed  # scale (max area) > 1 ha
        assert r.water_predicted_ci.count(" : ") == 1


def test_keep_nans(prepared):
    out = nrt_breaks(prepared, DW, "2019-06", keep_nans=True)
    assert out.count() == 100
    nan_rows = out.filter(F.col("water_observed").isNull()).collect()
    assert len(nan_rows) == 12
    assert all(r.drainage_confidence is None and r.water_historical_mean is not None for r in nan_rows)
    assert all(r.water_predicted_ci == "nan : nan" for r in nan_rows)


def test_planted_month_is_drained(spark):
    rows = nrt_month(planted_panel(spark, SF_MID), "2019-06", DW).collect()
    assert {r.id_geohash for r in rows} == {"lk000009", "lk000069"}  # planted at month 29
    assert all(r.water_residual < -0.25 and r.analysis_month == "2019-06" for r in rows)


def test_range_equals_single_months(spark):
    panel = planted_panel(spark, SF_MID)
    rng = {(r.analysis_month, r.id_geohash): r for r in nrt_range(panel, "2019-01", "2019-12", DW).collect()}
    single = {}
    for m in range(1, 13):
        month = f"2019-{m:02d}"
        for r in nrt_month(panel, month, DW).collect():
            single[(month, r.id_geohash)] = r
    assert set(rng) == set(single)
    for k, r in rng.items():
        assert r.water_residual == pytest.approx(single[k].water_residual, abs=1e-4)


def test_counts_include_zero_months(spark):
    panel = planted_panel(spark, SF_MID)
    counts = {r.analysis_month: r.drained_lake_count for r in nrt_range_counts(panel, "2017-01", "2021-12", DW).collect()}
    assert len(counts) == 60 and counts["2017-01"] == 0
    drained = nrt_range(panel, "2017-01", "2021-12", DW).groupBy("analysis_month").count().collect()
    for r in drained:
        assert counts[r.analysis_month] == r["count"]


def test_arima_forecast_runs(prepared):
    out = nrt_breaks(prepared, DW, "2019-06", forecast="arima")
    assert out.count() == 88
    assert out.filter(F.col("water_predicted").isNull()).count() == 0


def test_missing_date_raises(prepared):
    with pytest.raises(ValueError):
        nrt_breaks(prepared, DW, "2031-01")
