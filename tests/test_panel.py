"""Panel preparation, merges, gap report, long views."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from lakeshift.family import DW, detect_family
from lakeshift.operators.merge import MergeError, merge_panels
from lakeshift.operators.panel import gap_report, prepare
from lakeshift.operators.views import to_long
from lakeshift.sources.derived import planted_panel, ship_panel


def test_planted_panel_shape(spark):
    p = planted_panel(spark, SF_MID)
    assert p.count() == 6000
    prepared = prepare(p, DW)
    assert prepared.filter("valid").count() == 5261


def test_normalised_in_unit_interval(spark):
    prepared = prepare(planted_panel(spark, SF_MID), DW).filter("valid")
    agg = prepared.agg(F.min("water_norm"), F.max("water_norm"), F.max("area_data_norm")).first()
    assert 0 <= agg[0] and agg[1] <= 1 and agg[2] <= 1 + 1e-12


def test_totals_except_gap_months(spark):
    p = planted_panel(spark, SF_MID)
    bad = p.filter(F.col("bare") > 0).filter(
        F.abs(F.col("water") + F.col("snow_and_ice") + F.col("bare") - (F.lit(100.0) + (F.substring("id_geohash", 3, 6).cast("int") % 7) * 10)) > 1e-9)
    assert bad.count() == 0


def test_family_detection():
    assert detect_family(["id_geohash", "date", "water"]).name == "dynamic_world"
    assert detect_family(["area_water_permanent", "water"]).name == "jrc"
    with pytest.raises(ValueError):
        detect_family(["id_geohash", "foo"])


def test_merge_errors(spark):
    p = ship_panel(spark, SF_SMALL)
    with pytest.raises(MergeError):
        merge_panels(p, p.drop("water").withColumn("foo", F.lit(1.0)))
    conflict = p.withColumn("water", F.col("water") + 1)
    with pytest.raises(Exception, match="conflicting values"):
        merge_panels(p, conflict, how="both").count()
    a = p.filter(F.col("id_geohash") < "sp000005")
    with pytest.raises(MergeError):
        merge_panels(a, p, how="date")  # id sets differ


def test_merge_second_wins(spark):
    p = ship_panel(spark, SF_SMALL)
    b = p.withColumn("water", F.lit(-1.0))
    out = merge_panels(p, b, how="date")
    assert out.count() == p.count()
    assert out.filter(F.col("water") != -1.0).count() == 0


def test_gap_report_sorted_and_bounded(spark):
    rep = gap_report(prepare(ship_panel(spark, SF_MID), DW)).collect()
    pcts = [r.completion_pct for r in rep]
    assert pcts == sorted(pcts) and all(p < 50 for p in pcts)


def test_to_long_variables(spark):
    long = to_long(ship_panel(spark, SF_SMALL))
    names = {r.variable for r in long.select("variable").distinct().collect()}
    assert names == {"water", "vegetation", "crops", "built", "bare", "snow_and_ice"}
