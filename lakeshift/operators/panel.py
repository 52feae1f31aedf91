"""Panel preparation and panel-level filters.

A *panel* is a long DataFrame ``(id_geohash, date, <class>...)`` with one row
per lake and date. Preparation adds the total and missing area, the lake
maximum, normalised twins ``<c>_norm`` and a ``valid`` flag, and NULLs every
value of a masked row. All of it is one window over ``id_geohash`` (a single
hash exchange) plus row-local expressions.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..family import DATE, ID, Family, detect_family
from ..functions.numeric import nan_to_null, round_even_sql

NORM = "_norm"


def norm(c: str) -> str:
    return c + NORM


def clean_nan(df: DataFrame, family: Family) -> DataFrame:
    """NaN -> NULL for every class column (done once at ingest)."""
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in family.classes else F.col(c) for c in df.columns])


def area_sum(family: Family) -> Column:
    expr = None
    for c in family.sum_order:
        expr = F.col(c) if expr is None else expr + F.col(c)
    return expr


def _q(name: str) -> str:
    return f"`{name}`"


def add_area(df: DataFrame, family: Family | None = None) -> DataFrame:
    """``area_data`` (plain sum: one NULL class -> NULL total), lake max and
    ``area_nodata = round(max - area_data, 4)`` (numpy rounding).

    The lake window is ordered by date with a whole-lake frame: the (id, date)
    sort it needs is the one the rolling windows downstream need, so Spark
    sorts once. Built as SQL text: one projection call, not one per column.
    """
    family = family or detect_family(df)
    total = " + ".join(_q(c) for c in family.sum_order)
    frame = (f"PARTITION BY {_q(ID)} ORDER BY {_q(DATE)} "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    staged = df.selectExpr("*", f"{total} AS area_data", f"max({total}) OVER ({frame}) AS max_area")
    return staged.selectExpr("*", f"{round_even_sql('max_area - area_data', 4)} AS area_nodata")


def prepare(df: DataFrame, family: Family | None = None, mask: bool = True,
            nodata_max: float = 0.0, limits: dict | None = None,
            keep_raw: bool = True, carry: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Area, normalisation and masking in one pass.

    Output: id, date, raw classes, area_data, area_nodata, max_area, the same
    values divided by max_area with suffix ``_norm``, and ``valid``. When
    ``mask`` is true, every value column of an invalid row is NULL.
    ``carry`` names extra input columns passed through unchanged.
    ``partitions`` fixes the task count of the one exchange (a repartition by
    lake that AQE does not coalesce): use it before CPU-heavy grouped pandas
    kernels, whose thin input AQE would otherwise pack into a few tasks.
    """
    family = family or detect_family(df)
    limits = family.limits if limits is None else limits
    variables = list(family.classes) + ["area_data", "area_nodata"]
    src = df.select(ID, DATE, *family.classes, *carry)
    if partitions:
        src = src.repartition(int(partitions), ID)
    base = add_area(src, family)
    normed = {v: f"try_divide({_q(v)}, max_area)" for v in variables}
    ok = f"{normed['area_nodata']} <= {float(nodata_max)!r}D"
    for c, lim in limits.items():
        ok += f" AND {normed[c]} <= {float(lim)!r}D"
    with_valid = base.selectExpr("*", f"{'coalesce(' + ok + ', false)' if mask else 'true'} AS valid")
    keep = (lambda e: f"CASE WHEN valid THEN {e} END") if mask else (lambda e: e)
    cols = [_q(ID), _q(DATE)]
    if keep_raw:
        cols += [f"{keep(_q(v))} AS {_q(v)}" for v in variables]
    cols += ["max_area"]
    cols += [f"{keep(normed[v])} AS {_q(norm(v))}" for v in variables]
    cols += ["valid"] + [_q(c) for c in carry]
    return with_valid.selectExpr(*cols)


def normalize(df: DataFrame, family: Family | None = None) -> DataFrame:
    """Every variable divided by the lake's maximum total area (P2), unmasked."""
    return prepare(df, family, mask=False)


def mask_invalid(df: DataFrame, family: Family | None = None, nodata_max: float = 0.0,
                 limits: dict | None = None, enabled: bool = True) -> DataFrame:
    """P1-P3 with the masking switch of the reference (``mask_data``)."""
    return prepare(df, family, mask=enabled, nodata_max=nodata_max, limits=limits)


def normalize_rows(df: DataFrame, exclude: tuple[str, ...] = ("year", "month", "reducer")) -> DataFrame:
    """Divide each value by (area_data + area_nodata) of the same row (P5)."""
    denom = F.col("area_data") + F.col("area_nodata")
    keep = {ID, DATE, *exclude}
    return df.select(*[F.col(c) if c in keep else F.try_divide(F.col(c), denom).alias(c) for c in df.columns])


def gap_report(df: DataFrame, variable: str = "water", threshold: float = 50.0,
               ids: DataFrame | None = None) -> DataFrame:
    """Missing count and completion % per lake over the panel's dates (P11), of all lakes or those in ``ids``.

    Dates absent for a lake count as missing: the denominator is the number
    of distinct dates of the whole panel, computed first as one scalar (a
    scalar subquery would be re-run at each of its uses in the expressions).
    """
    n_dates = F.lit(df.select(F.countDistinct(DATE)).first()[0] or 0)
    if ids is not None:
        df = df.join(ids.select(ID).distinct(), ID, "left_semi")
    per_lake = df.groupBy(ID).agg(F.count(F.col(variable)).alias("n_present"))
    missing = n_dates - F.col("n_present")
    out = per_lake.select(
        ID,
        missing.cast("long").alias("missing_count"),
        ((n_dates - missing) / n_dates * F.lit(100.0)).alias("completion_pct"))
    return out.filter(F.col("completion_pct") < F.lit(float(threshold))).orderBy("completion_pct", ID)


def split_at(df: DataFrame, analysis_date) -> tuple[DataFrame, DataFrame]:
    """(rows at the analysis date, rows strictly before it)."""
    d = F.lit(analysis_date).cast("date")
    return df.filter(F.col(DATE) == d), df.filter(F.col(DATE) < d)


def same_month_history(df: DataFrame, month: int) -> DataFrame:
    """Keep one calendar month of every year."""
    return df.filter(F.month(DATE) == F.lit(int(month)))


def resolve_analysis_date(df: DataFrame, analysis: str) -> DataFrame:
    """One-row frame with the analysis date.

    ``'YYYY-MM'`` resolves to the first panel date in that month; any other
    text is parsed as a date and must exist in the panel. Returns zero rows
    when the date is not present, so callers can fail fast with a count of 1.
    """
    month_ts = F.try_to_timestamp(F.lit(analysis), F.lit("yyyy-MM"))
    any_ts = F.to_date(F.lit(analysis))
    is_month = month_ts.isNotNull() & (F.length(F.lit(analysis)) == 7)
    target_month = F.trunc(month_ts.cast("date"), "month")
    dates = df.select(DATE).distinct()
    hit = F.when(is_month, F.trunc(F.col(DATE), "month") == target_month).otherwise(F.col(DATE) == any_ts)
    return dates.filter(hit).agg(F.min(DATE).alias(DATE)).filter(F.col(DATE).isNotNull())


def valid_lakes_at(df: DataFrame, analysis_date, variables: list[str]) -> DataFrame:
    """``(id, is_valid)`` at the date: valid if any variable is non-NULL (F8)."""
    at = df.filter(F.col(DATE) == F.lit(analysis_date).cast("date"))
    return at.select(ID, F.coalesce(*[F.col(v) for v in variables]).isNotNull().alias("is_valid"))


def filter_ids(df: DataFrame, ids: DataFrame, on_missing: str = "warn") -> tuple[DataFrame, DataFrame]:
    """Keep lakes listed in ``ids`` (F3). Returns (kept rows, requested ids not present).

    ``on_missing``: ``warn`` warns where some ids are absent and raises where
    all are, ``error`` raises where any is, ``ignore`` does not look.
    """
    if on_missing not in ("warn", "error", "ignore"):
        raise ValueError("on_missing is warn, error or ignore")
    ids = ids.select(ID).distinct()
    kept = df.join(ids, ID, "left_semi")
    missing = ids.join(df.select(ID), ID, "left_anti")
    if on_missing != "ignore":
        absent, wanted = missing.count(), ids.count()
        if absent and (on_missing == "error" or absent == wanted):
            raise ValueError(f"{absent} of {wanted} requested lakes are not in the panel")
        if absent:
            warnings.warn(f"{absent} of {wanted} requested lakes are not in the panel", stacklevel=2)
    return kept, missing


def site_series(df: DataFrame, lake_id: str, cols: list[str] | None = None) -> DataFrame:
    """One lake, valid rows only (F12); pushed down as a Parquet equality filter."""
    one = df.filter(F.col(ID) == F.lit(lake_id))
    if cols:
        one = one.select(ID, DATE, *cols)
    if "area_nodata" in one.columns:
        return one.filter(F.col("area_nodata") == 0)
    return one.dropna()


def object_ids(df: DataFrame) -> DataFrame:
    return df.select(ID).distinct()


def dates(df: DataFrame) -> DataFrame:
    return df.select(DATE).distinct()


def availability(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, available)`` for each requested id."""
    present = df.select(ID).distinct().withColumn("available", F.lit(True))
    return (ids.select(ID).distinct().join(present, ID, "left")
               .select(ID, F.coalesce("available", F.lit(False)).alias("available")))
