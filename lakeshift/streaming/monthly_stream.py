"""New months as a file-source stream (T4).

New panel rows (any number of lakes, one or more months) land as Parquet
files in a folder. Each micro-batch is added to the history table, joined to
the per-lake state of all earlier rows (``lake_state``) and the months it
carries are analysed, as the range job would analyse them over the whole
panel. The history is read once, for the state before the first batch.

A batch may be delivered again after a failure. Everything it writes is
therefore keyed: the history and the state by batch, results and counts by
month, and a second delivery replaces the first. Of rows of one lake and date
in several batches the latest batch decides. The checkpoint folder makes a
restart resume after the last committed batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..family import DATE, ID, Family, detect_family
from ..operators.nrt import DRAIN_THRESHOLD
from ..plans.nrt_jobs import write_months
from ..session import written
from .lake_state import FIRST, analysed, compacted, grouped, merged, state_before, write_version


def batches_path(history_path: str) -> str:
    """Where batches are added, beside a history that was there before the stream."""
    return f"{history_path.rstrip('/')}_batches"


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_history(spark: SparkSession, history_path: str, before: int | None = None) -> DataFrame | None:
    """The first history and all batches (those below ``before``), one row per lake and date; None without any."""
    first, later = read_or_none(spark, history_path), read_or_none(spark, batches_path(history_path))
    if later is not None and before is not None:
        later = later.filter(F.col("batch") < before)
    parts = [p for p in (first.withColumn("batch", F.lit(-1)) if first is not None else None, later) if p is not None]
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in rows.columns if c not in (ID, DATE, "batch")]
    latest = rows.groupBy(ID, DATE).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(ID, DATE, "v.*")


def process_batch(batch: DataFrame, history_path: str, out_dir: str, family: Family | None = None,
                  threshold: float = DRAIN_THRESHOLD, batch_id: int = 0, forecast: str = "ar1",
                  orders: dict | None = None) -> None:
    """Add batch ``batch_id`` to the history and analyse the months it carries, with any of the forecasts."""
    spark = batch.sparkSession
    family = family or detect_family(batch)
    batch.persist()
    try:
        # the months of one batch: a handful of rows
        months = sorted(r[0] for r in batch.select(F.date_format(DATE, "yyyy-MM")).distinct().collect())
        if not months:
            return
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(batches_path(history_path)))
    finally:
        batch.unpersist()
    state = state_before(spark, history_path, batch_id)
    if state is None:
        state = first_state(spark, history_path, family, batch_id)
    whole = written(merged(state, grouped(batch, family)), "merged")
    write_version(compacted(whole), history_path, batch_id)
    rows = analysed(whole, family, months, forecast, orders)
    found = written(rows.filter(F.col("failed") | (F.col("water_residual") < F.lit(threshold))), "found")
    write_months(found, months, out_dir)


def first_state(spark: SparkSession, history_path: str, family: Family, batch_id: int) -> DataFrame | None:
    """The state of the history and of batches before ``batch_id``, written as the first version."""
    rows = read_history(spark, history_path, before=batch_id)
    if rows is None:
        return None
    write_version(compacted(merged(None, grouped(rows, family))), history_path, FIRST)
    return state_before(spark, history_path, batch_id)


def start_monthly_stream(spark: SparkSession, incoming_dir: str, schema: StructType, history_path: str,
                         out_dir: str, checkpoint: str, family: Family | None = None,
                         threshold: float = DRAIN_THRESHOLD, available_now: bool = True, forecast: str = "ar1",
                         orders: dict | None = None):
    """Start the stream; with ``available_now`` it drains the folder and stops."""
    stream = spark.readStream.schema(schema).parquet(incoming_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: process_batch(df, history_path, out_dir, family, threshold, epoch,
                                                              forecast, orders))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
