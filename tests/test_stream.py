"""New months through a file-source stream (availableNow) equal the batch job."""
import os
import uuid

from pyspark.sql import functions as F

from conftest import SF_MID
from lakeshift.family import DW
from lakeshift.plans.nrt_jobs import nrt_month
from lakeshift.session import checkpoint_dir
from lakeshift.sources.derived import planted_panel
from lakeshift.streaming.monthly_stream import start_monthly_stream


def test_stream_matches_batch(spark):
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    panel = planted_panel(spark, SF_MID)
    d = F.lit("2019-06-01").cast("date")
    panel.filter(F.col("date") < d).write.parquet(f"{base}/history")
    panel.filter(F.col("date") == d).write.parquet(f"{base}/incoming")
    q = start_monthly_stream(spark, f"{base}/incoming", panel.schema, f"{base}/history", f"{base}/out",
                             f"{base}/ckpt", DW)
    q.awaitTermination(300)
    got = {r.id_geohash for r in spark.read.parquet(f"{base}/out/breaks").collect()}
    want = {r.id_geohash for r in nrt_month(panel.filter(F.col("date") <= d), "2019-06", DW).collect()}
    assert got == want
    counts = spark.read.parquet(f"{base}/out/counts").collect()
    assert [(c.analysis_month, c.drained_lake_count) for c in counts] == [("2019-06", len(want))]


def months_of(panel, *months):
    return panel.filter(F.date_format("date", "yyyy-MM").isin(*months))


def results(spark, out):
    rows = spark.read.parquet(f"{out}/breaks")
    return sorted((r.analysis_month, r.id_geohash, r.water_predicted, r.water_residual, r.water_historical_median,
                   r.water_historical_std, r.water_observed_absolute, r.drainage_confidence) for r in rows.collect())


def test_state_gives_what_the_whole_panel_gives(spark):
    """Months one by one, one of them twice, with late, corrected, growing and broken rows: as the range job over all."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    k = F.expr("int(substring(id_geohash, 3))")
    panel = planted_panel(spark, SF_MID)
    # some lakes grow in May and July: a larger total remasks and rescales their whole history
    grows = (k % 7 == 0) & (F.col("date") == F.lit("2019-05-01").cast("date"))
    little = (k % 7 == 1) & (F.col("date") == F.lit("2019-07-01").cast("date"))
    panel = (panel.withColumn("bare", F.when(grows, F.col("bare") + 3.0).when(little, F.col("bare") + 0.00003).otherwise(F.col("bare")))
             .withColumn("water", F.when((k % 11 == 0) & (F.month("date") == 3), None).otherwise(F.col("water"))))
    late = (k % 5 == 0) & (F.col("date") == F.lit("2019-02-01").cast("date"))
    history = panel.filter((F.col("date") < F.lit("2019-05-01").cast("date")) & ~late)
    history.write.parquet(f"{base}/history")
    batches = [months_of(panel, "2019-05").unionByName(panel.filter(late)), months_of(panel, "2019-06"),
               months_of(panel, "2019-07", "2019-08").unionByName(
                   months_of(panel, "2019-06").filter(k % 13 == 0).withColumn("water", F.col("water") * 0.5))]
    from lakeshift.plans.nrt_jobs import nrt_range
    from lakeshift.streaming.monthly_stream import process_batch, read_history
    want, fields = {}, ("water_predicted", "water_residual", "water_historical_median", "water_historical_std",
                        "water_observed_absolute", "drainage_confidence")
    poison = f"{base}/history/zz.parquet"
    for n, batch in enumerate(batches):
        for _ in range(2 if n == 1 else 1):
            if n:  # after the first batch a reader of the history fails
                with open(poison, "w") as f:
                    f.write("no parquet")
            process_batch(batch, f"{base}/history", f"{base}/out", DW, batch_id=n)
            if n:
                os.remove(poison)
        months = sorted(r[0] for r in batch.select(F.date_format("date", "yyyy-MM")).distinct().collect())
        found = nrt_range(read_history(spark, f"{base}/history"), months[0], months[-1], DW)
        want = {key: v for key, v in want.items() if key[0] not in months}
        want |= {(r.analysis_month, r.id_geohash): tuple(r[f] for f in fields)
                 for r in found.filter(F.col("analysis_month").isin(months)).collect()}
    got = {r[:2]: r[2:] for r in results(spark, f"{base}/out")}
    assert got.keys() == want.keys() and len(want) > 10
    for key, values in got.items():
        assert all(a == b or abs(a - b) < 2e-4 for a, b in zip(values, want[key])), key


def test_stream_with_another_forecast(spark):
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    panel = planted_panel(spark, "/root/testdata/sf0.001")
    months_of(panel, *[f"20{y}-{m:02d}" for y in (17, 18) for m in range(1, 13)]).write.parquet(f"{base}/history")
    from lakeshift.plans.nrt_jobs import nrt_range
    from lakeshift.streaming.monthly_stream import process_batch
    orders = {"max_p": 1, "max_d": 1, "max_q": 1}
    process_batch(months_of(panel, "2019-01"), f"{base}/history", f"{base}/out", DW, batch_id=0, forecast="arima_ml",
                  orders=orders, threshold=2.0)
    seen = panel.filter(F.col("date") <= F.lit("2019-01-01").cast("date"))
    want = {r.id_geohash: r.water_predicted for r in nrt_range(
        seen, "2019-01", "2019-01", DW, forecast="arima_ml", orders=orders, drained_only=False).collect()}
    got = {r[1]: r[2] for r in results(spark, f"{base}/out")}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
