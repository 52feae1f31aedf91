"""One-step-ahead forecast of each lake's water series.

``ar1``  : conditional least squares on consecutive pairs ``(x[t-1], x[t])``
           of the non-NULL history, from SQL regression aggregates (pure
           Catalyst, checkable against an SQL oracle). Interval:
           ``pred +- z * sigma`` with ``sigma^2 = SSE / n_pairs``. A series
           with zero variance has no slope; it forecasts its last value with
           zero width.
``arima``: grouped numpy kernel through ``applyInPandas``: ARIMA(p, d, 0)
           with p <= 2 and d <= 1 chosen by AIC (conditional least squares),
           non-seasonal. Used where the AR(1) form is too rigid.
``arima_ml``: ARIMA(p, d, q) by exact maximum likelihood, differences by the
           KPSS test, orders by stepwise search (``arima.py``), for batches
           of series at a time. Used where shocks fade over a few dates,
           which only moving-average terms describe.
All need ``min_length`` (3) non-NULL history values, else NULL. A series
that the kernels cannot handle (values that are not finite) gets NULL and
the reason in ``forecast_error``; it does not fail the job.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..family import DATE, ID

# Fixed value: two-sided 90 % normal quantile.
Z90 = 1.6448536269514722
MIN_LENGTH = 3


def ar1_aggregates(y: Column, x_prev: Column) -> list[Column]:
    """Aggregates a ``groupBy`` (or window) needs for the AR(1) forecast."""
    return [
        F.count(y).alias("n_hist"),
        F.regr_count(y, x_prev).alias("n_pairs"),
        F.regr_slope(y, x_prev).alias("ar_slope"),
        F.regr_intercept(y, x_prev).alias("ar_intercept"),
        F.regr_syy(y, x_prev).alias("ar_syy"),
        F.regr_sxy(y, x_prev).alias("ar_sxy"),
        F.max_by(y, F.when(y.isNotNull(), F.col(DATE))).alias("x_last"),
    ]


def ar1_prediction(min_length: int = MIN_LENGTH) -> tuple[Column, Column, Column]:
    """(predicted, lower_90, upper_90) from the columns of ``ar1_aggregates``."""
    enough = F.col("n_hist") >= F.lit(min_length)
    has_slope = F.col("ar_slope").isNotNull()
    pred = F.when(enough, F.when(has_slope, F.col("ar_intercept") + F.col("ar_slope") * F.col("x_last"))
                  .otherwise(F.col("x_last")))
    # residual sum of squares; an exact fit (two pairs, or a remainder below
    # floating resolution) is exactly zero rather than +-1e-17 of rounding noise
    raw = F.col("ar_syy") - F.col("ar_slope") * F.col("ar_sxy")
    sse = (F.when(F.col("n_pairs") <= 2, F.lit(0.0))
            .when(raw <= F.lit(1e-12) * F.col("ar_syy"), F.lit(0.0))
            .otherwise(raw))
    sigma = F.when(has_slope, F.sqrt(sse / F.col("n_pairs"))).otherwise(F.lit(0.0))
    half = F.lit(Z90) * sigma
    return pred, F.when(enough, pred - half), F.when(enough, pred + half)


# --------------------------------------------------------------------------- arima kernel

def _fit_ar(z: np.ndarray, p: int, m: int):
    """Least squares AR(p) with intercept on the last ``m`` values; (coef, sigma2, aic) or None."""
    if m < p + 2:
        return None
    start = len(z) - m
    X = np.column_stack([np.ones(m)] + [z[start - k - 1: len(z) - k - 1] for k in range(p)])
    y = z[start:]
    coef, *_ = np.linalg.lstsq(X, y, rcond=None)
    sse = float(((y - X @ coef) ** 2).sum())
    if sse <= 1e-12 * max(float(((y - y.mean()) ** 2).sum()), float((y ** 2).sum()), 1e-300):
        return coef, 0.0, -np.inf  # an exact fit, but for rounding
    return coef, sse / m, m * np.log(sse / m) + 2 * (p + 2)


def arima_one_step(values: np.ndarray, max_p: int = 2, max_d: int = 1) -> tuple[float, float, float, str]:
    """Forecast the next value: best ARIMA(p, d, 0) with p <= ``max_p``, d <= ``max_d``, by AIC.

    All orders are fitted to the same last values, so that their criteria
    compare; the largest orders are given up where too few values remain.
    Ties go to the smaller order.
    """
    best = None
    while max_p + max_d and len(values) - max_p - max_d < max_p + 2:
        max_p, max_d = (max_p - 1, max_d) if max_p else (0, max_d - 1)
    m = len(values) - max_p - max_d
    for d in range(max_d + 1):
        z = np.diff(values, d) if d else values
        for p in range(max_p + 1):
            fit = _fit_ar(z, p, m)
            if fit is not None and (best is None or fit[2] < best[0]):
                best = (fit[2], d, p, fit[0], fit[1], z)
    if best is None or np.var(values) == 0:
        last = float(values[-1])
        return last, last, last, "naive"
    _, d, p, coef, sigma2, z = best
    pred = float(coef[0] + sum(coef[k + 1] * z[-k - 1] for k in range(p)))
    for k in range(d - 1, -1, -1):  # undo the differences
        pred += float((np.diff(values, k) if k else values)[-1])
    half = Z90 * np.sqrt(sigma2)
    return pred, pred - half, pred + half, f"arima({p},{d},0)"


FORECAST = ("water_predicted", "water_predicted_lower_90", "water_predicted_upper_90")
FORECASTS = ("ar1", "arima", "arima_ml")
#: Series that one call of the likelihood kernel takes; bounds its memory.
BATCH = 512


def by_regression(series: list[np.ndarray]) -> list[tuple]:
    """The ``ar1`` forecast of each series, as ``ar1_aggregates`` gives it."""
    out = []
    for v in series:
        x, y = v[:-1], v[1:]
        pred, sigma = float(v[-1]), 0.0
        sxx = float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0
        if sxx > 0:
            sxy, syy = float(((x - x.mean()) * (y - y.mean())).sum()), float(((y - y.mean()) ** 2).sum())
            slope = sxy / sxx
            pred = float(y.mean() - slope * x.mean() + slope * v[-1])
            sse = syy - slope * sxy
            sigma = 0.0 if len(x) <= 2 or sse <= 1e-12 * syy else float(np.sqrt(sse / len(x)))
        out.append((pred, pred - Z90 * sigma, pred + Z90 * sigma, "ar1"))
    return out


def stats_of(values: list[float] | None) -> tuple:
    """Mean, median, sample deviation, minimum and maximum, as the SQL aggregates give them."""
    v = np.array(values or [], dtype=float)
    if not len(v):
        return (None,) * 5
    return (float(v.mean()), float(np.median(v)), float(v.std(ddof=1)) if len(v) > 1 else None, float(v.min()),
            float(v.max()))


STATS = ("h_mean", "h_median", "h_std", "h_min", "h_max")


def by_least_squares(series: list[np.ndarray], **orders) -> list[tuple]:
    return [arima_one_step(s, **orders) for s in series]


def by_likelihood(series: list[np.ndarray], **orders) -> list[tuple]:
    from .arima import one_step
    found = one_step(series, **orders)
    names = [f"arima({p},{d},{q})" for p, d, q in zip(found["p"], found["d"], found["q"])]
    return list(zip(*(found[c].tolist() for c in ("predicted", "lower", "upper")), names))


def forecast_rows(series: list[list[float] | None], method: str, min_length: int, orders: dict) -> list[tuple]:
    """``(predicted, lower, upper, forecast_method, forecast_error)`` of each series; failures stay with their series."""
    kernel = {"ar1": by_regression, "arima": by_least_squares, "arima_ml": by_likelihood}[method]
    out: list[tuple] = [(None,) * 5] * len(series)
    fit = []
    for i, s in enumerate(series):
        values = np.array(s or [], dtype=float)
        if len(values) < min_length:
            continue
        if not np.isfinite(values).all():
            out[i] = (None, None, None, None, "values that are not finite")
        else:
            fit.append((i, values))
    for at in range(0, len(fit), BATCH):
        part = fit[at: at + BATCH]
        try:
            found = kernel([v for _, v in part], **orders)
        except (np.linalg.LinAlgError, FloatingPointError):
            found = []
            for _, v in part:  # one by one: the series at fault keeps its error
                try:
                    found += kernel([v], **orders)
                except (np.linalg.LinAlgError, FloatingPointError) as exc:
                    found.append((None, None, None, None, str(exc)))
        for (i, _), row in zip(part, found):
            out[i] = (*row, None) if len(row) == 4 else row
    return out


def forecast_of_series(rows: DataFrame, keys: list[str], method: str = "arima_ml", min_length: int = MIN_LENGTH,
                       stats: bool = False, **orders) -> DataFrame:
    """``keys``, the forecast columns, ``forecast_method`` and ``forecast_error`` of ``rows (keys, series)``;
    with ``stats`` also the history's ``h_mean, h_median, h_std, h_min, h_max``.

    ``series`` is an array of values in order of time, bounded by the dates
    of a panel. The kernel reads Arrow batches; partitioning is kept.
    """
    import pyarrow as pa
    from ..session import ship_package
    ship_package(rows.sparkSession)
    slim = rows.select(*keys, "series")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys]
    schema = ", ".join([*fields, *[f"{c} double" for c in FORECAST], "forecast_method string", "forecast_error string",
                        *[f"{c} double" for c in STATS if stats]])
    names = [*keys, *FORECAST, "forecast_method", "forecast_error", *(STATS if stats else ())]

    def kernel(batches):
        for batch in batches:
            series = batch.column(len(keys)).to_pylist()
            found = forecast_rows(series, method, min_length, orders)
            kinds = [pa.float64()] * 3 + [pa.string()] * 2
            if stats:
                found = [(*f, *stats_of(s)) for f, s in zip(found, series)]
                kinds += [pa.float64()] * 5
            columns = list(zip(*found)) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)

    return slim.mapInArrow(kernel, schema)


def arima_forecast(history: DataFrame, value: str, min_length: int = MIN_LENGTH, partitions: int | None = None,
                   method: str = "arima", **orders) -> DataFrame:
    """Per-lake forecast of the value after the last of ``history``, from ``(id, date, value)`` alone.

    ``orders`` bound the search: ``max_p``, ``max_d`` and, for ``arima_ml``,
    ``max_q``. The task count comes from the input's partitioning by lake
    (see ``prepare(..., partitions=...)``); ``partitions`` adds a repartition
    of the thin frame for inputs not partitioned by lake.
    """
    slim = history.select(ID, DATE, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    if partitions:
        slim = slim.repartition(int(partitions), ID)
    pairs = F.array_sort(F.collect_list(F.struct(DATE, "v")))
    series = slim.groupBy(ID).agg(F.transform(pairs, lambda s: s["v"]).alias("series"))
    return forecast_of_series(series, [ID], method, min_length, **orders)
