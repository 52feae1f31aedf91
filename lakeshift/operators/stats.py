"""Per-lake and per-month aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..family import DATE, ID, Family
from .panel import norm


def lake_max_area(prepared: DataFrame, masked: bool = True) -> DataFrame:
    """Max area per lake: of the masked ``area_data`` (NRT scaling) or the raw one."""
    if masked:
        return prepared.groupBy(ID).agg(F.max("area_data").alias("max_area"))
    return prepared.groupBy(ID).agg(F.max("max_area").alias("max_area"))


def history_stats(prepared: DataFrame, family: Family, before=None, month: int | None = None,
                  normalised: bool = True) -> DataFrame:
    """``water_historical_{mean,median,std,min,max}`` per lake.

    Optional: only dates before ``before``, only one calendar ``month``.
    """
    col = norm(family.water_col) if normalised else family.water_col
    rows = prepared
    if before is not None:
        rows = rows.filter(F.col(DATE) < F.lit(before).cast("date"))
    if month is not None:
        rows = rows.filter(F.month(DATE) == F.lit(int(month)))
    x = F.col(col)
    return rows.groupBy(ID).agg(
        F.avg(x).alias("water_historical_mean"),
        F.median(x).alias("water_historical_median"),
        F.stddev_samp(x).alias("water_historical_std"),
        F.min(x).alias("water_historical_min"),
        F.max(x).alias("water_historical_max"),
    )


def month_spine(spark, start: str, end: str) -> DataFrame:
    """Inclusive list of ``YYYY-MM`` months (T1); error when reversed."""
    from .nrt import parse_analysis_date
    s, e = parse_analysis_date(start), parse_analysis_date(end)
    if s > e:
        raise ValueError("analysis_date_start must not be after analysis_date_end")
    seq = F.sequence(F.lit(s).cast("date"), F.lit(e).cast("date"), F.expr("interval 1 month"))
    months = spark.range(1).select(F.explode(seq).alias("m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("analysis_month"))


def monthly_counts(drained_rows: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """``(analysis_month, drained_lake_count INT)`` (G9); with ``months`` every
    processed month appears, zero when nothing drained (J5)."""
    counts = drained_rows.groupBy("analysis_month").agg(F.count(F.lit(1)).alias("n"))
    if months is None:
        return counts.select("analysis_month", F.col("n").cast("int").alias("drained_lake_count"))
    return (months.select("analysis_month").distinct()
                  .join(counts, "analysis_month", "left")
                  .select("analysis_month", F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("drained_lake_count")))


def counts_matrix(counts: DataFrame) -> DataFrame:
    """Year x month table of mean counts, missing 0, newest year first."""
    ym = counts.select(F.substring("analysis_month", 1, 4).cast("int").alias("year"),
                       F.substring("analysis_month", 6, 2).cast("int").alias("month"),
                       F.col("drained_lake_count").cast("double").alias("n"))
    wide = ym.groupBy("year").agg(*[
        F.coalesce(F.avg(F.when(F.col("month") == m, F.col("n"))), F.lit(0.0)).alias(f"m{m:02d}")
        for m in range(1, 13)])
    return wide.orderBy(F.desc("year"))
