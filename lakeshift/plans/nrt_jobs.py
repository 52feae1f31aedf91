"""NRT jobs: one month (D6), a month range (D7), resume (T3), consolidation (K6)."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..family import DATE, ID, Family, detect_family
from ..operators.nrt import (DRAIN_THRESHOLD, drained, nrt_all_dates, nrt_breaks, parse_analysis_date,
                             with_month)
from ..operators.panel import prepare
from ..operators.stats import month_spine, monthly_counts
from ..session import cut_lineage
from ..sinks.writers import write_nrt_month


def month_date(panel: DataFrame, month: str):
    """First panel date inside ``month`` ('YYYY-MM').

    One small aggregate over the rows of that month: a range of dates, which
    the scan pushes down, and the year of a panel written by year, which
    prunes its partitions. The result is a single scalar. A month missing
    from the panel raises, as the reference does.
    """
    first = dt.date.fromisoformat(str(parse_analysis_date(month))[:10]).replace(day=1)
    after = (first + dt.timedelta(days=31)).replace(day=1)
    inside = (F.col(DATE) >= F.lit(first)) & (F.col(DATE) < F.lit(after))
    if "year" in panel.columns:
        inside = inside & (F.col("year") == first.year)
    d = panel.filter(inside).agg(F.min(DATE)).first()[0]
    if d is None:
        raise ValueError(f"the panel has no date in {month}")
    return F.lit(d)


def nrt_month(panel: DataFrame, month: str, family: Family | None = None,
              threshold: float = DRAIN_THRESHOLD, period: str = "all", ids: DataFrame | None = None,
              drained_only: bool = True, forecast: str = "ar1", orders: dict | None = None) -> DataFrame:
    """Drained lakes of one month with ``analysis_month`` first, sorted by id.

    Only lakes whose raw water is present at the analysis date take part
    (then the usual validity test after masking applies).
    """
    family = family or detect_family(panel)
    if ids is not None:
        panel = panel.join(ids.select(ID).distinct(), ID, "left_semi")
    d = month_date(panel, month)
    # one window over the lake (same partitioning as prepare) flags lakes
    # with raw water at the analysis date
    whole = Window.partitionBy(ID).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw_ok = F.max(F.when(F.col(DATE) == d, F.col(family.water_col).isNotNull())).over(whole)
    usable = panel.withColumn("_raw_ok", raw_ok).filter(F.col("_raw_ok")).drop("_raw_ok")
    result = nrt_breaks(prepare(usable, family), family, d, period=period, forecast=forecast, orders=orders)
    if drained_only:
        result = drained(result, threshold)
    return with_month(result).sortWithinPartitions(ID)


def nrt_range(panel: DataFrame, start: str, end: str, family: Family | None = None,
              threshold: float = DRAIN_THRESHOLD, period: str = "all",
              drained_only: bool = True, forecast: str = "ar1", orders: dict | None = None) -> DataFrame:
    """Every analysis date in [start, end] in one job (D7), with any of the forecasts of ``nrt_month``."""
    family = family or detect_family(panel)
    flagged = panel.withColumn("_raw_ok", F.col(family.water_col).isNotNull())
    prepared = prepare(flagged, family, carry=("_raw_ok",))
    result = nrt_all_dates(prepared, family, start, end, period=period, row_filter=F.col("_raw_ok"),
                           forecast=forecast, orders=orders)
    if drained_only:
        result = drained(result, threshold)
    return with_month(result)


def drained_or_failed(panel: DataFrame, months: list[str], family: Family, threshold: float, forecast: str,
                      orders: dict | None) -> DataFrame:
    """Drained lakes of ``months``, and lakes whose forecast failed (column ``failed``), written once."""
    flagged = panel.withColumn("_raw_ok", F.col(family.water_col).isNotNull())
    prepared = prepare(flagged, family, carry=("_raw_ok",))
    result = nrt_all_dates(prepared, family, months[0], last_day(months[-1]), row_filter=F.col("_raw_ok"),
                           forecast=forecast, orders=orders, mark_failed=True)
    rows = with_month(result).filter(F.col("analysis_month").isin(months))
    return cut_lineage(rows.filter(F.col("failed") | (F.col("water_residual") < F.lit(threshold))))


def last_day(month: str) -> str:
    first = dt.date.fromisoformat(f"{month}-01")
    return ((first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)).isoformat()


def write_months(found: DataFrame, months: list[str], out_dir: str) -> None:
    """Month files and the counts table of ``drained_or_failed`` rows, both replaced month by month."""
    spark = found.sparkSession
    write_nrt_month(found.filter(~F.col("failed")).drop("failed"), f"{out_dir}/breaks", months)
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in months])).alias("analysis_month"))
    counts = found.groupBy("analysis_month").agg(F.count_if(~F.col("failed")).cast("int").alias("drained_lake_count"),
                                                 F.count_if("failed").cast("int").alias("failed"))
    write_counts(spine.join(counts, "analysis_month", "left").fillna(0), f"{out_dir}/counts")


def nrt_range_counts(panel: DataFrame, start: str, end: str, family: Family | None = None,
                     threshold: float = DRAIN_THRESHOLD) -> DataFrame:
    """Drained-lake count per month of the range, zero months included (G9 + J5)."""
    rows = nrt_range(panel, start, end, family, threshold)
    return monthly_counts(rows, month_spine(panel.sparkSession, start, end))


def read_counts(spark, counts_path: str, failed: bool = False) -> DataFrame | None:
    """The written counts table, or None if nothing was written; any other failure is raised.

    ``failed`` adds the number of lakes whose forecast failed in the month
    (NULL where the table was written without it).
    """
    schema = "analysis_month string, drained_lake_count int" + (", failed int" if failed else "")
    try:
        return spark.read.schema(schema).parquet(counts_path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def pending_months(spark, start: str, end: str, counts_path: str | None) -> DataFrame:
    """Months of the range not yet in the written counts table."""
    months = month_spine(spark, start, end)
    done = read_counts(spark, counts_path) if counts_path is not None else None
    return months if done is None else months.join(done, "analysis_month", "left_anti")


def write_counts(counts: DataFrame, counts_path: str) -> None:
    """One partition per month, so that a month written again replaces itself."""
    (counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("analysis_month").parquet(counts_path))


def run_nrt_range(panel: DataFrame, start: str, end: str, out_dir: str, family: Family | None = None,
                  threshold: float = DRAIN_THRESHOLD, resume: bool = True, forecast: str = "ar1",
                  orders: dict | None = None) -> DataFrame:
    """Write drained lakes partitioned by month plus a counts table; skip done months.

    Only the span of the pending months is analysed. Months are replaced as a
    whole, also by nothing, so that a run may be repeated. A lake whose
    forecast fails is counted in its month (column ``failed`` of the counts
    table) and leaves the rest of the month complete.
    """
    spark = panel.sparkSession
    family = family or detect_family(panel)
    counts_path = f"{out_dir}/counts"
    # twelve rows a year
    todo = sorted(r[0] for r in pending_months(spark, start, end, counts_path if resume else None).collect())
    if todo:
        write_months(drained_or_failed(panel, todo, family, threshold, forecast, orders), todo, out_dir)
    return read_counts(spark, counts_path)


def consolidate(out_dir: str, spark, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All months in one table and the counts table (K6); written under ``path`` if given."""
    breaks = spark.read.option("mergeSchema", "true").parquet(f"{out_dir}/breaks")
    counts = read_counts(spark, f"{out_dir}/counts")
    if path is not None:
        breaks.repartitionByRange("analysis_month", ID).write.mode("overwrite").parquet(f"{path}/breaks")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
        breaks, counts = spark.read.parquet(f"{path}/breaks"), spark.read.parquet(f"{path}/counts")
    return breaks, counts
