"""Merges of two panels: one job for the keys, warnings on overlaps, one winner among equal keys."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lakeshift.operators.merge import MergeError, key_overlaps, merge_append, merge_both, merge_conflicts
from lakeshift.operators.panel import prepare
from lakeshift.operators.pixels import best_scene_of_pixels
from lakeshift.sinks.writers import write_panel
from lakeshift.sources.derived import planted_panel


@pytest.fixture(scope="module")
def halves(spark):
    panel = planted_panel(spark, SF_SMALL)
    day = F.lit("2019-06-01").cast("date")
    return panel.filter(F.col("date") <= day), panel.filter(F.col("date") >= day)


def test_overlaps_are_counted_and_warned_about(halves):
    a, b = halves
    found = key_overlaps(a, b)
    assert found["id_geohash"] == (0, 0, 10) and found["date"] == (29, 30, 1)
    with pytest.warns(UserWarning, match="1 date values"):
        merged = merge_append(a, b.withColumn("water", F.col("water") + 1), "date")
    assert merged.count() == 600
    day = F.col("date") == F.lit("2019-06-01").cast("date")
    first = {r.id_geohash: r.water for r in a.filter(day).collect()}
    assert all(r.water == first[r.id_geohash] + 1 for r in merged.filter(day).collect())
    with pytest.raises(MergeError, match="3 are in the first alone"):
        merge_append(a, b.filter("id_geohash > 'lk000002'"), "date")


def test_repeated_keys_have_one_winner(spark):
    schema = "id_geohash string, date date, water double, bare double"
    rows = spark.createDataFrame([("a", None, 1.0, 5.0), ("a", None, 2.0, 1.0)], schema).withColumn("date", F.lit("2020-01-01").cast("date"))
    none = rows.limit(0)
    for part in (rows, rows.orderBy(F.desc("water")), rows.repartition(5)):
        assert [tuple(r)[2:] for r in merge_append(part, none, validate=False).collect()] == [(2.0, 1.0)]


def test_full_merge_shuffles_once_without_settings(spark, halves):
    a, b = halves
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    try:
        merged = merge_both(a, b)
        plan = prepare(merged)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1
        assert merged.count() == 600 and merge_conflicts(a, b).count() == 0
        bad = b.withColumn("water", F.col("water") + 1)
        assert merge_conflicts(a, bad).count() == 10
        with pytest.raises(Exception, match="conflicting values"):
            merge_both(a, bad).count()
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)


def test_written_panel_is_few_sorted_files(spark, tmp_path):
    import glob
    import pyarrow.parquet as pq
    panel = planted_panel(spark, SF_SMALL).repartition(16)
    write_panel(panel, str(tmp_path / "p"))
    files = glob.glob(f"{tmp_path}/p/year=*/*.parquet")
    assert len(files) <= 5 + 4  # years, and one more where a border cuts one
    for f in files:
        rows = pq.read_table(f, columns=["id_geohash", "date"]).to_pylist()
        assert rows == sorted(rows, key=lambda r: (r["id_geohash"], r["date"]))


def test_best_scene_counts_missing_pixels(spark):
    rows = [("a", "s1", "2024-01-01 01:00:00", None), ("a", "s1", "2024-01-01 01:00:00", 1.0),
            ("a", "s2", "2024-01-01 05:00:00", 1.0), ("a", "s2", "2024-01-01 05:00:00", float("nan")),
            ("a", "s3", "2024-01-01 09:00:00", 3.0), ("a", "s4", "2024-01-02 01:00:00", None)]
    pixels = spark.createDataFrame(rows, "id_geohash string, scene_id string, time string, b4 double")
    found = best_scene_of_pixels(pixels.withColumn("time", F.col("time").cast("timestamp"))).orderBy("day").collect()
    assert [(r.scene_id, r.missing_red) for r in found] == [("s3", 0), ("s4", 1)]
