"""Rolling-window detector: planted drops, schema, hand cases."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from lakeshift.family import DW, JRC
from lakeshift.operators.breaks import BREAK_COLUMNS, simple_breaks
from lakeshift.operators.panel import prepare
from lakeshift.sources.derived import planted_jrc, planted_panel


def _expected_first_valid(prepared):
    """Planted break month per lake: first valid month at or after the plant."""
    rows = prepared.select("id_geohash", "date", "valid").collect()
    out = {}
    for r in rows:
        k = int(r.id_geohash[2:])
        if k % 3:
            continue
        m = 20 + k % 20
        plant = dt.date(2017 + m // 12, m % 12 + 1, 1)
        if r.valid and r.date >= plant and (r.id_geohash not in out or r.date < out[r.id_geohash]):
            out[r.id_geohash] = r.date
    return out


@pytest.mark.parametrize("method", ["median", "mean", "max"])
def test_planted_breaks_found_exactly(spark, method):
    prepared = prepare(planted_panel(spark, SF_MID), DW)
    got = {r.id_geohash: r.date_break for r in simple_breaks(prepared, DW, method=method).collect()}
    assert got == _expected_first_valid(prepared)
    assert len(got) == 34


def test_jrc_twin_same_lakes(spark):
    prepared = prepare(planted_jrc(spark, SF_MID), JRC)
    got = simple_breaks(prepared, JRC).select("id_geohash").collect()
    assert len(got) == 34
    assert prepared.filter("valid").count() == 5739


def test_schema_and_method(spark):
    prepared = prepare(planted_panel(spark, SF_MID), DW)
    out = simple_breaks(prepared, DW)
    assert out.columns == BREAK_COLUMNS
    assert {r.break_method for r in out.select("break_method").distinct().collect()} == {"simple"}
    with pytest.raises(ValueError):
        simple_breaks(prepared, DW, method="mode")


def _panel(spark, rows):
    cols = "id_geohash string, date date, water double, trees double, grass double, flooded_vegetation double, " \
           "crops double, shrub_and_scrub double, built double, bare double, snow_and_ice double"
    return spark.createDataFrame(rows, cols)


def _series(lake, waters, total=100.0):
    out = []
    for i, w in enumerate(waters):
        d = dt.date(2020 + i // 12, i % 12 + 1, 1)
        if w is None:
            out.append((lake, d) + (None,) * 9)
        else:
            out.append((lake, d, w, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, total - w, 0.0))
    return out


def test_hand_cases(spark):
    rows = (_series("allnull", [None] * 8)
            + _series("constant", [50.0] * 10)
            + _series("lastrow", [80.0] * 9 + [10.0])           # break on the last valid row: no confirmation
            + _series("vanish", [80.0] * 6 + [0.0] * 4))        # post-break median 0 -> NULL change
    prepared = prepare(_panel(spark, rows), DW)
    got = {r.id_geohash: r for r in simple_breaks(prepared, DW).collect()}
    assert set(got) == {"vanish"}
    v = got["vanish"]
    assert v.post_break_median is None and v.water_change_ha is None and v.water_change_perc is None
    assert v.date_break == dt.date(2020, 7, 1)
    assert v.date_before_break == dt.date(2020, 6, 1) and v.date_after_break == dt.date(2020, 8, 1)


def test_nan_is_masked(spark):
    rows = _series("nan", [80.0] * 10)
    rows[3] = rows[3][:2] + (float("nan"),) + rows[3][3:]
    prepared = prepare(_panel(spark, rows), DW)
    r = prepared.filter(F.col("date") == dt.date(2020, 4, 1)).first()
    assert r.valid is False and r.water is None


def test_one_exchange(spark):
    prepared = prepare(planted_panel(spark, SF_MID), DW)
    plan = simple_breaks(prepared, DW)._jdf.queryExecution().executedPlan().toString()
    # a cached input prints its exchange twice, as planned and as run
    assert len(set(re.findall(r"Exchange .*plan_id=(\d+)", plan))) == 1
