"""Rolling statistics over the valid rows of each lake."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..family import DATE, ID

METHODS = ("max", "mean", "median")


def lake_order() -> Window:
    return Window.partitionBy(ID).orderBy(DATE)


def rolling(col: Column, method: str, window: int, rn: Column | None = None) -> Column:
    """Statistic over the last ``window`` rows incl. the current one.

    NULL until ``window`` rows exist (pandas ``min_periods = window``).
    ``median`` rejects a frame in Spark, ``percentile(c, 0.5)`` accepts it and
    interpolates like pandas for even windows.
    """
    if method not in METHODS:
        raise ValueError(f"rolling method {method!r} is none of {', '.join(METHODS)}")
    frame = lake_order().rowsBetween(-(window - 1), 0)
    if method == "max":
        stat = F.max(col).over(frame)
    elif method == "mean":
        stat = F.avg(col).over(frame)
    else:
        stat = _median_of_lags(col, window)
    rn = F.row_number().over(lake_order()) if rn is None else rn
    return F.when(rn >= F.lit(window), stat)


def _median_of_lags(col: Column, window: int) -> Column:
    """Median of the current and ``window - 1`` previous rows.

    Offset windows (``lag``) plus a sort of a tiny array: generated code and
    O(w log w) per row, where a sliding ``percentile`` frame rebuilds its
    buffer. NULL when a value in the window is NULL (pandas needs ``window``
    observations); even windows average the two middle values.
    """
    vals = [col] + [F.lag(col, k).over(lake_order()) for k in range(1, window)]
    n_null = None
    for v in vals:
        flag = v.isNull().cast("int")
        n_null = flag if n_null is None else n_null + flag
    srt = F.sort_array(F.array(*vals))
    if window % 2:
        med = F.element_at(srt, window // 2 + 1)
    else:
        med = (F.element_at(srt, window // 2) + F.element_at(srt, window // 2 + 1)) / F.lit(2.0)
    return F.when(n_null == 0, med)
