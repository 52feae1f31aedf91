"""Data-quality predicates (M15) and driver-side parameter checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text forms.
MONTH_PATTERN = r"^\d{4}-\d{2}$"
GEOHASH_PATTERN = r"^[0-9a-zA-Z]{1,12}$"
DW_FIRST_YEAR = 2016
JRC_YEARS = (1984, 2021)


def is_month(c: Column) -> Column:
    """``YYYY-MM`` text."""
    return F.coalesce(c.rlike(MONTH_PATTERN), F.lit(False))


def is_geohash(c: Column) -> Column:
    """1 to 12 alphanumeric characters."""
    return F.coalesce(c.rlike(GEOHASH_PATTERN), F.lit(False))


def is_lat(c: Column) -> Column:
    return F.coalesce(c.between(-90.0, 90.0), F.lit(False))


def is_lon(c: Column) -> Column:
    return F.coalesce(c.between(-180.0, 180.0), F.lit(False))


def valid_years(years, family: str = "dw") -> list[int]:
    """Years the imagery family covers; others are dropped with a message.

    DW: 2016 .. current year (default all of them); JRC: 1984 .. 2021.
    """
    if family == "dw":
        lo, hi = DW_FIRST_YEAR, dt.date.today().year
    else:
        lo, hi = JRC_YEARS
    if years is None:
        return list(range(lo, hi + 1))
    if not isinstance(years, (list, tuple, range)):
        raise ValueError("years is a list, a range or None")
    kept = []
    for y in years:
        if isinstance(y, int) and lo <= y <= hi:
            kept.append(y)
        else:
            print(f"left out year {y!r}: not in {lo}..{hi}")
    return kept
