"""Historical break detection: rolling-window detector and break statistics.

``simple_breaks`` is pure Catalyst: after ``prepare`` has hash-partitioned the
panel by lake, the rolling windows, the first-break window and the final
``groupBy`` all reuse that partitioning, so the whole detector costs one
shuffle of ``(id, date, water)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..family import DATE, ID, Family, detect_family
from .panel import norm, prepare
from .rolling import METHODS, lake_order, rolling

STATS = ("mean", "median", "std", "min", "max")

BREAK_COLUMNS = (
    [ID, "date_break", "date_before_break", "date_after_break", "break_method"]
    + [f"pre_break_{s}" for s in STATS] + [f"post_break_{s}" for s in STATS]
    + ["date_break_year", "date_break_month", "water_change_ha", "water_change_perc"]
)


def _stat(name: str, c: Column) -> Column:
    return {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max}[name](c)


def five_stats(c: Column, prefix: str) -> list[Column]:
    """mean, median (exact), sample std, min, max of ``c`` (NULLs skipped)."""
    return [_stat(s, c).alias(f"{prefix}_{s}") for s in STATS]


def change_stats(df: DataFrame, zero_as_null: bool = True) -> DataFrame:
    """Zero medians -> NULL, break year/month, change in ha and %."""
    pre, post = F.col("pre_break_median"), F.col("post_break_median")
    if zero_as_null:
        pre = F.when(pre != 0, pre)
        post = F.when(post != 0, post)
    # one projection (chained withColumn calls re-analyse the plan each time)
    return df.withColumns({
        "pre_break_median": pre,
        "post_break_median": post,
        "date_break_year": F.year("date_break"),
        "date_break_month": F.month("date_break"),
        "water_change_ha": post - pre,
        "water_change_perc": F.try_divide(post - pre, pre) * F.lit(100.0),
    })


def complete(family: Family) -> Column:
    """Rows a detector works on: valid, and no class missing (also where nothing was masked)."""
    cond = F.col("valid")
    for c in family.classes:
        cond = cond & F.col(norm(c)).isNotNull()
    return cond


def simple_breaks(prepared: DataFrame, family: Family, window: int = 3, method: str = "median",
                  threshold: float = -0.25) -> DataFrame:
    """First drainage break per lake.

    On valid rows only: ``(v - roll_w)[t] < thr`` and ``(v - roll_{w+2})[t+1] < thr``.
    Before/after dates are the neighbouring valid rows. Pre-break statistics
    include the break date, post-break statistics start at the next valid
    row; both on the absolute masked water area. Lakes without a break give
    no row.
    """
    if method not in METHODS:
        raise ValueError(f"rolling method {method!r} is none of {', '.join(METHODS)}")
    wa, wn = family.water_col, norm(family.water_col)
    rows = prepared.filter(complete(family)).select(ID, DATE, F.col(wa).alias("wa"), F.col(wn).alias("wn"))
    w = lake_order()
    rn = F.row_number().over(w)
    v = F.col("wn")
    hit_p = F.coalesce(v - rolling(v, method, window, rn) < F.lit(threshold), F.lit(False))
    hit_s = F.coalesce(v - rolling(v, method, window + 2, rn) < F.lit(threshold), F.lit(False))
    flagged = (rows.withColumns({"hit_p": hit_p, "hit_s": hit_s, "prev_date": F.lag(DATE, 1).over(w),
                                 "next_date": F.lead(DATE, 1).over(w)})
                   .withColumn("is_break", F.col("hit_p") & F.lead("hit_s", 1, False).over(w)))
    whole_lake = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    with_brk = (flagged.withColumn("brk", F.min(F.when(F.col("is_break"), F.col(DATE))).over(whole_lake))
                       .filter(F.col("brk").isNotNull()))
    at_brk = F.col(DATE) == F.col("brk")
    pre = F.when(F.col(DATE) <= F.col("brk"), F.col("wa"))
    post = F.when(F.col(DATE) > F.col("brk"), F.col("wa"))
    out = with_brk.groupBy(ID).agg(
        F.min("brk").alias("date_break"),
        F.max(F.when(at_brk, F.col("prev_date"))).alias("date_before_break"),
        F.max(F.when(at_brk, F.col("next_date"))).alias("date_after_break"),
        F.lit("simple").alias("break_method"),
        *five_stats(pre, "pre_break"),
        *five_stats(post, "post_break"),
    )
    return change_stats(out).select(*BREAK_COLUMNS)


def break_statistics(rows: DataFrame, water: str, breaks: DataFrame) -> DataFrame:
    """Pre/post statistics for several breaks per lake.

    ``rows``: (id, date, <water>) absolute masked values; ``breaks``: (id,
    date_break, ...). Running statistics are windows over each lake's rows
    (growing frame up to the row; frame from the next row on), joined back to
    the breaks on the full key (id, date) -- no pairs of rows are formed.
    """
    w = Window.partitionBy(ID).orderBy(DATE)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    x = F.col(water)
    stats = rows.select(
        ID, DATE,
        F.avg(x).over(upto).alias("pre_break_mean"),
        F.percentile(x, F.lit(0.5)).over(upto).alias("pre_break_median"),
        F.stddev_samp(x).over(upto).alias("pre_break_std"),
        F.min(x).over(upto).alias("pre_break_min"),
        F.max(x).over(upto).alias("pre_break_max"),
        F.avg(x).over(after).alias("post_break_mean"),
        F.percentile(x, F.lit(0.5)).over(after).alias("post_break_median"),
        F.stddev_samp(x).over(after).alias("post_break_std"),
        F.min(x).over(after).alias("post_break_min"),
        F.max(x).over(after).alias("post_break_max"),
    ).withColumnRenamed(DATE, "date_break")
    return change_stats(breaks.join(stats, [ID, "date_break"], "left"))


def all_breaks(panel: DataFrame, method: str = "simple", family: Family | None = None,
               mask: bool = True, **kwargs) -> DataFrame:
    """Every lake of a panel in one job (D3): prepare, then the chosen detector."""
    family = family or detect_family(panel)
    if method == "simple":
        prepared = prepare(panel, family, mask=mask)
    else:  # Python kernels: fixed task count for the one exchange
        from ..session import kernel_partitions
        prepared = prepare(panel, family, mask=mask, partitions=kernel_partitions(panel.sparkSession))
    if method == "simple":
        return simple_breaks(prepared, family, **kwargs)
    if method in ("bayes", "beast"):
        from .bayes import bayes_breaks
        return bayes_breaks(prepared, family, **kwargs)
    if method in _DETECTORS:
        return run_detector(prepared, family, method)
    raise ValueError(f"unknown break method {method!r}")


# --- user-defined detectors (D10) -------------------------------------------

_DETECTORS: dict[str, tuple[Callable, str]] = {}

DETECTOR_SCHEMA = f"{ID} string, date_break date, date_before_break date, date_after_break date"


def register_detector(name: str, fn: Callable, schema: str = DETECTOR_SCHEMA) -> None:
    """Register ``fn(pdf) -> pdf`` run once per lake through ``applyInPandas``.

    ``pdf`` holds one lake's valid rows ``(id_geohash, date, water, water_norm)``
    sorted by date; the result follows ``schema``. A detector returning an
    empty frame reports no break (the base behaviour).
    """
    _DETECTORS[name] = (fn, schema)


def no_break(pdf):
    """Base detector: never reports a break."""
    import pandas as pd
    return pd.DataFrame({ID: pd.Series(dtype=str), "date_break": pd.Series(dtype="datetime64[ns]"),
                         "date_before_break": pd.Series(dtype="datetime64[ns]"),
                         "date_after_break": pd.Series(dtype="datetime64[ns]")})


register_detector("none", no_break)


def run_detector(prepared: DataFrame, family: Family, name: str) -> DataFrame:
    from ..session import ship_package
    ship_package(prepared.sparkSession)
    fn, schema = _DETECTORS[name]
    wa, wn = family.water_col, norm(family.water_col)
    rows = prepared.filter(complete(family)).select(ID, DATE, F.col(wa).alias("water"), F.col(wn).alias("water_norm"))

    def per_lake(pdf):
        return fn(pdf.sort_values(DATE).reset_index(drop=True))

    found = rows.groupBy(ID).applyInPandas(per_lake, schema=schema)
    found = found.withColumn("break_method", F.lit(name))
    return break_statistics(rows.select(ID, DATE, "water"), "water", found)
