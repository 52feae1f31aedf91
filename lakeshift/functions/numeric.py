"""Scalar numeric helpers: half-even rounding, interval text, confidence, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL, so aggregates skip it like the array reductions do."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def round_even(c: Column, places: int = 4) -> Column:
    """numpy's ``round``: ``rint(x * 10**n) / 10**n`` (half to even on the scaled double).

    ``bround`` rounds the exact binary value instead and disagrees on cases
    such as 123.135 (numpy: 123.14, ``bround``: 123.13).
    """
    scale = F.lit(float(10 ** places))
    return F.rint(c * scale) / scale


def round_even_sql(expr: str, places: int = 4) -> str:
    """``round_even`` as Spark SQL text (for projections built with selectExpr)."""
    return f"(rint(({expr}) * {float(10 ** places)!r}D) / {float(10 ** places)!r}D)"


def py_float_text(c: Column) -> Column:
    """Text of a double as Python's ``str(float)`` prints it; NULL -> ``'nan'``.

    Spark switches to scientific notation at 1e7, Python at 1e16; in between
    the value is printed with ``format_string``. Inputs here are already
    rounded to two places.
    """
    big = F.abs(c) >= F.lit(1e7)
    return (F.when(c.isNull(), F.lit("nan"))
             .when(big & (F.abs(c) < F.lit(1e16)),
                   F.regexp_replace(F.format_string("%.2f", c), r"(\.\d*?)0+$", "$1"))
             .otherwise(c.cast("string")))


def _fix_trailing_dot(s: Column) -> Column:
    return F.regexp_replace(s, r"\.$", ".0")


def interval_text(lower: Column, upper: Column) -> Column:
    """``'<lower> : <upper>'`` with each bound rounded half-even to 2 places."""
    lo = _fix_trailing_dot(py_float_text(round_even(lower, 2)))
    hi = _fix_trailing_dot(py_float_text(round_even(upper, 2)))
    return F.concat_ws(" : ", lo, hi)


def drainage_confidence(residual: Column, observed: Column, lower: Column, hist_min: Column,
                        threshold: float = -0.25) -> Column:
    """Number of satisfied drainage tests (0..3); a NULL test counts as false."""
    tests = [residual < F.lit(threshold), observed < lower, observed < hist_min]
    total = F.lit(0)
    for t in tests:
        total = total + F.coalesce(t, F.lit(False)).cast("int")
    return total.cast("int")


def clip_value(c: Column | None, default: float = 0.0, lo: float = -50.0, hi: float = 50.0) -> Column:
    """Fill missing with ``default`` then clip to [lo, hi]; absent column -> default."""
    if c is None:
        return F.lit(float(default))
    filled = F.coalesce(nan_to_null(c.cast("double")), F.lit(float(default)))
    return F.least(F.greatest(filled, F.lit(float(lo))), F.lit(float(hi)))


def round_half_up(c: Column, places: int = 4) -> Column:
    """``round(x * 10**n) / 10**n`` half away from zero on the scaled double."""
    scale = F.lit(float(10 ** places))
    return F.round(c * scale, 0) / scale


def round_output(df, places: int = 4):
    """Round every DOUBLE column half-up to ``places`` (report output only)."""
    from pyspark.sql.types import DoubleType, FloatType
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_half_up(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
