"""Near-real-time (NRT) drainage check of one analysis date.

For every lake: observed normalised water at the analysis date, a one-step
forecast from the earlier history, history statistics, a 0..3 confidence
score, absolute twins (x max masked area) and interval text. One ``groupBy``
on the prepared panel computes all of it (no joins of per-lake frames);
with ``forecast='arima'`` the numpy kernel result is joined back on id.

``nrt_all_dates`` gives the same result for every date of a range at once:
the history aggregates become running windows, so a whole month range is
one job instead of one job per month.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..family import DATE, ID, Family
from ..functions.numeric import drainage_confidence, interval_text, round_even
from .forecast import FORECAST, FORECASTS, ar1_aggregates, ar1_prediction, arima_forecast, forecast_of_series
from .panel import norm

HIST = ("mean", "median", "std", "min", "max")
VALUE_COLS = ["water_observed", "water_predicted", "water_residual", "water_predicted_lower_90",
              "water_predicted_upper_90"] + [f"water_historical_{s}" for s in HIST]
NRT_COLUMNS = (["date"] + VALUE_COLS + ["drainage_confidence"]
               + [f"{c}_absolute" for c in VALUE_COLS]
               + ["water_predicted_ci", "water_predicted_ci_absolute"])
DRAIN_THRESHOLD = -0.25


def parse_analysis_date(analysis) -> str:
    """A date, or text that names one, as ISO date; text without a day means the first of its month."""
    try:
        return pd.Timestamp(analysis).date().isoformat()
    except (ValueError, TypeError) as exc:
        raise ValueError(f"{analysis!r} is no analysis date") from exc


def _hist_stats(c: Column) -> list[Column]:
    return [F.avg(c).alias("h_mean"), F.median(c).alias("h_median"), F.stddev_samp(c).alias("h_std"),
            F.min(c).alias("h_min"), F.max(c).alias("h_max")]


def _finish(df: DataFrame, observed: Column, pred: Column, lower: Column, upper: Column,
            date_col: Column, is_valid: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rounding order of the reference, confidence, absolutes and interval text; ``extra`` columns pass through."""
    r = lambda c: round_even(c, 4)
    out = df.select(
        ID, date_col.alias("date"), is_valid.alias("_valid"), F.col("scale"), *extra,
        r(observed).alias("water_observed"),
        r(pred).alias("water_predicted"),
        r(lower).alias("water_predicted_lower_90"),
        r(upper).alias("water_predicted_upper_90"),
        *[r(F.col(f"h_{s}")).alias(f"water_historical_{s}") for s in HIST],
    ).withColumn("water_residual", r(F.col("water_observed") - F.col("water_predicted")))
    conf = drainage_confidence(F.col("water_residual"), F.col("water_observed"),
                               F.col("water_predicted_lower_90"), F.col("water_historical_min"))
    absolute = {f"{c}_absolute": F.col(c) * F.col("scale") for c in VALUE_COLS}
    # one projection for confidence, absolutes and interval text
    return out.select(
        ID, "date", *VALUE_COLS, F.when(F.col("_valid"), conf).cast("int").alias("drainage_confidence"),
        *[e.alias(k) for k, e in absolute.items()],
        interval_text(F.col("water_predicted_lower_90"), F.col("water_predicted_upper_90"))
        .alias("water_predicted_ci"),
        interval_text(absolute["water_predicted_lower_90_absolute"], absolute["water_predicted_upper_90_absolute"])
        .alias("water_predicted_ci_absolute"), *extra,
    ).select(ID, *NRT_COLUMNS, *extra)


def nrt_breaks(prepared: DataFrame, family: Family, analysis_date, period: str = "all",
               keep_nans: bool = False, ids: DataFrame | None = None, forecast: str = "ar1",
               min_length: int = 3, check_date: bool = True, orders: dict | None = None) -> DataFrame:
    """NRT result for one analysis date: id + 24 columns.

    ``forecast`` is ``ar1``, ``arima`` or ``arima_ml``; ``orders`` bounds the
    search of the latter two (``max_p``, ``max_d``, ``max_q``).

    ``prepared`` comes from ``prepare``. Valid lakes (any variable present
    at the date) are returned; with ``keep_nans`` the other lakes too, with
    history statistics only. A date absent from the panel raises
    (``check_date``).
    """
    if period not in ("all", "monthly"):
        raise ValueError("data_aggregation_period must be 'all' or 'monthly'")
    d = analysis_date if isinstance(analysis_date, Column) else \
        F.lit(parse_analysis_date(analysis_date)).cast("date")
    if check_date and not isinstance(analysis_date, Column):
        # one pushed-down probe, as the reference refuses a date it does not hold
        if prepared.filter(F.col(DATE) == d).limit(1).count() == 0:
            raise ValueError(f"the panel has no rows of {analysis_date}")
    if ids is not None:
        prepared = prepared.join(ids.select(ID).distinct(), ID, "left_semi")
    wn = F.col(norm(family.water_col))
    variables = [norm(c) for c in family.classes] + [norm("area_data"), norm("area_nodata")]
    in_hist = F.col(DATE) < d
    if period == "monthly":
        in_hist = in_hist & (F.month(DATE) == F.month(d))
    w = Window.partitionBy(ID).orderBy(DATE)
    rows = (prepared.select(ID, DATE, wn.alias("wn"), F.col("area_data"),
                            F.coalesce(*[F.col(v) for v in variables]).isNotNull().alias("any_value"))
                    .withColumn("hw", F.when(in_hist, F.col("wn"))))
    rows = rows.withColumn("xp", F.last("hw", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    at = F.col(DATE) == d
    agg = rows.groupBy(ID).agg(
        F.max(F.when(at, F.col("wn"))).alias("obs"),
        F.max(F.when(at, F.col("any_value"))).alias("valid_at"),
        F.max("area_data").alias("scale"),
        *ar1_aggregates(F.col("hw"), F.col("xp")),
        *_hist_stats(F.col("hw")),
    )
    valid = F.coalesce(F.col("valid_at"), F.lit(False))
    if not keep_nans:
        agg = agg.filter(valid)
    if forecast == "ar1":
        pred, lower, upper = ar1_prediction(min_length)
    elif forecast in FORECASTS:
        fc = arima_forecast(rows.filter(F.col("hw").isNotNull()), "hw", min_length, method=forecast, **(orders or {}))
        agg = agg.join(fc.select(ID, *FORECAST), ID, "left")
        pred, lower, upper = (F.col(c) for c in FORECAST)
    else:
        raise ValueError(f"unknown forecast {forecast!r}")
    keep = lambda c: F.when(valid, c)
    return _finish(agg, keep(F.col("obs")), keep(pred), keep(lower), keep(upper),
                   F.when(valid, d), valid)


def nrt_all_dates(prepared: DataFrame, family: Family, start=None, end=None,
                  period: str = "all", min_length: int = 3, row_filter: Column | None = None,
                  forecast: str = "ar1", orders: dict | None = None, mark_failed: bool = False) -> DataFrame:
    """NRT result of every valid (lake, date) in [start, end] at once.

    ``forecast`` is ``ar1`` (running regression sums), ``arima`` or
    ``arima_ml`` (one kernel row per analysed lake and date, with the history
    before it). A forecast that fails, or is not a number, is NULL and leaves
    the other lakes alone; ``mark_failed`` adds a column ``failed``.

    Each row is analysed against the history before it: running window
    aggregates over the lake's rows replace the per-month loop. Work per
    lake is O(n) for sums and O(n^2) only for the running median (series
    are bounded by the number of dates).
    """
    wn = F.col(norm(family.water_col))
    variables = [norm(c) for c in family.classes] + [norm("area_data"), norm("area_nodata")]
    part = [ID] if period == "all" else [ID, F.month(DATE)]
    w = Window.partitionBy(*part).orderBy(DATE)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(ID).orderBy(DATE).rowsBetween(Window.unboundedPreceding,
                                                             Window.unboundedFollowing)
    usable = F.coalesce(*[F.col(v) for v in variables]).isNotNull()
    if row_filter is not None:
        usable = usable & F.coalesce(row_filter, F.lit(False))
    rows = (prepared.select(ID, DATE, wn.alias("wn"), F.col("area_data"), usable.alias("any_value"))
                    .withColumn("scale", F.max("area_data").over(whole)))
    if end is not None:
        # rows after the range are neither analysed nor history of an analysed
        # row; only the scale (computed above) needed them
        rows = rows.filter(F.col(DATE) <= F.lit(parse_analysis_date(end)).cast("date"))
    rows = rows.withColumn("xp", F.last("wn", ignorenulls=True).over(before))
    # each row carries its pair (xp, y); the frame [.., -1] of an analysis
    # row therefore sees exactly the pairs of its history
    y, xp = F.col("wn"), F.col("xp")
    stats = rows.select(
        ID, DATE, "wn", "any_value", "scale",
        F.count(y).over(before).alias("n_hist"),
        F.regr_count(y, xp).over(before).alias("n_pairs"),
        F.regr_slope(y, xp).over(before).alias("ar_slope"),
        F.regr_intercept(y, xp).over(before).alias("ar_intercept"),
        F.regr_syy(y, xp).over(before).alias("ar_syy"),
        F.regr_sxy(y, xp).over(before).alias("ar_sxy"),
        F.last(y, ignorenulls=True).over(before).alias("x_last"),
        F.avg(y).over(before).alias("h_mean"),
        F.percentile(y, F.lit(0.5)).over(before).alias("h_median"),
        F.stddev_samp(y).over(before).alias("h_std"),
        F.min(y).over(before).alias("h_min"),
        F.max(y).over(before).alias("h_max"),
    )
    if start is not None:
        stats = stats.filter(F.col(DATE) >= F.lit(parse_analysis_date(start)).cast("date"))
    if end is not None:
        stats = stats.filter(F.col(DATE) <= F.lit(parse_analysis_date(end)).cast("date"))
    stats = stats.filter(F.col("any_value"))
    if forecast == "ar1":
        pred, lower, upper = ar1_prediction(min_length)
    elif forecast in FORECASTS:
        fc = forecast_of_series(histories(rows, part, start, end), [ID, DATE], forecast, min_length, **(orders or {}))
        stats = stats.join(fc.select(ID, DATE, *FORECAST, "forecast_error"), [ID, DATE], "left")
        pred, lower, upper = (F.col(c) for c in FORECAST)
    else:
        raise ValueError(f"unknown forecast {forecast!r}")
    if not mark_failed:
        return _finish(stats, F.col("wn"), pred, lower, upper, F.col(DATE), F.lit(True))
    error = F.col("forecast_error").isNotNull() if forecast != "ar1" else F.lit(False)
    stats = stats.withColumn("failed", error | F.coalesce(F.isnan(pred), F.lit(False)))
    good = lambda c: F.when(~F.col("failed"), c)
    return _finish(stats, F.col("wn"), good(pred), good(lower), good(upper), F.col(DATE), F.lit(True), ("failed",))


def histories(rows: DataFrame, part: list, start=None, end=None) -> DataFrame:
    """``(id, date, series)``: for each analysed row the values before its date, in order of time.

    ``part`` is the history's group: the lake, or the lake and calendar
    month. Arrays are bounded by the dates of a panel.
    """
    asked = F.col("any_value")
    if start is not None:
        asked = asked & (F.col(DATE) >= F.lit(parse_analysis_date(start)).cast("date"))
    if end is not None:
        asked = asked & (F.col(DATE) <= F.lit(parse_analysis_date(end)).cast("date"))
    row = F.struct(F.col(DATE).alias("t"), F.col("wn").alias("v"), asked.alias("asked"))
    keys = [c if isinstance(c, Column) else F.col(c) for c in part]
    whole = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(row)).alias("s"))
    each = whole.select(F.col("_k0").alias(ID), "s", F.explode(F.filter("s", lambda x: x["asked"])).alias("at"))
    earlier = F.filter("s", lambda x: (x["t"] < F.col("at.t")) & x["v"].isNotNull())
    return each.select(ID, F.col("at.t").alias(DATE), F.transform(earlier, lambda x: x["v"]).alias("series"))


def drained(nrt: DataFrame, threshold: float = DRAIN_THRESHOLD) -> DataFrame:
    """Residual strictly below the threshold."""
    return nrt.filter(F.col("water_residual") < F.lit(threshold))


def with_month(nrt: DataFrame) -> DataFrame:
    """``analysis_month`` first, then id and the NRT columns."""
    return nrt.select(F.date_format("date", "yyyy-MM").alias("analysis_month"), *nrt.columns)


ABSOLUTE = {c: f"{c}_absolute" for c in VALUE_COLS}


def rescale_and_attach(nrt: DataFrame, raw_panel: DataFrame, lakes: DataFrame, family: Family,
                       all_geoms: bool = True, add_ci: bool = True) -> DataFrame:
    """Recompute absolutes from the raw panel and attach polygons.

    Scale = the largest, over dates, sum of all variables of the raw panel
    (a missing class counts 0). Lakes: left (all polygons) or right (only
    lakes with a result) join; optional interval text; ordered by id.
    """
    total = None
    for c in family.classes:
        term = F.coalesce(F.col(c), F.lit(0.0))
        total = term if total is None else total + term
    scale = raw_panel.groupBy(ID).agg(F.max(total).alias("_scale"))
    rel = nrt.select(ID, "date", *VALUE_COLS, "drainage_confidence")
    scaled = rel.join(scale, ID, "left").select(
        ID, "date", *VALUE_COLS, *[(F.col(c) * F.col("_scale")).alias(ABSOLUTE[c]) for c in VALUE_COLS],
        "drainage_confidence")
    joined = lakes.select(ID, "rings").join(scaled, ID, "left" if all_geoms else "right")
    cols = [ID, "date", *VALUE_COLS]
    abs_cols = [ABSOLUTE[c] for c in VALUE_COLS]
    if add_ci:
        joined = (joined.withColumn("water_predicted_ci", interval_text(F.col("water_predicted_lower_90"),
                                                                        F.col("water_predicted_upper_90")))
                        .withColumn("water_predicted_ci_absolute",
                                    interval_text(F.col(ABSOLUTE["water_predicted_lower_90"]),
                                                  F.col(ABSOLUTE["water_predicted_upper_90"]))))
        cols.append("water_predicted_ci")
        abs_cols.append("water_predicted_ci_absolute")
    return joined.select(*cols, *abs_cols, "drainage_confidence", "rings").orderBy(ID)
