"""Merging two raw panels.

Both forms are a union and one aggregate. A full merge partitions the union
by lake id alone, so the windows of ``prepare`` that follow reuse that
exchange; an append combines rows of one key before its shuffle. Merge raw
panels, then prepare once.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..family import DATE, ID, detect_family


class MergeError(ValueError):
    pass


def _value_columns(a: DataFrame, b: DataFrame) -> list[str]:
    va = [c for c in a.columns if c not in (ID, DATE)]
    vb = [c for c in b.columns if c not in (ID, DATE)]
    if set(va) != set(vb):
        raise MergeError(f"datasets have different variables: {sorted(set(va) ^ set(vb))}")
    if detect_family(va) != detect_family(vb):
        raise MergeError("datasets are of different types")
    for c in va:
        if dict(a.dtypes)[c] != dict(b.dtypes)[c]:
            raise MergeError(f"variable {c} has different types")
    return va


def _sides(a: DataFrame, b: DataFrame, cols: list[str]) -> tuple[DataFrame, Column]:
    """One row per (id, date) with the values of both sides (``<c>_0``, ``<c>_1``), and whether any differ.

    Of several rows of one side and key the greatest value of each variable
    counts. One exchange, by lake.
    """
    both = (a.select(ID, DATE, *cols, F.lit(0).alias("_side"))
            .unionByName(b.select(ID, DATE, *cols, F.lit(1).alias("_side"))).repartition(F.col(ID)))
    sides = [F.max(F.when(F.col("_side") == k, F.col(c))).alias(f"{c}_{k}") for c in cols for k in (0, 1)]
    differs = None
    for c in cols:
        x, y = F.col(f"{c}_0"), F.col(f"{c}_1")
        d = x.isNotNull() & y.isNotNull() & (x != y)
        differs = d if differs is None else differs | d
    return both.groupBy(ID, DATE).agg(*sides), differs


def merge_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, date) keys where both panels hold different non-NULL values."""
    sides, differs = _sides(a, b, _value_columns(a, b))
    return sides.filter(differs).select(ID, DATE)


def merge_both(a: DataFrame, b: DataFrame, validate: bool = True) -> DataFrame:
    """Full outer merge on (id, date) (J2): equal or one-sided values are kept,
    conflicting values fail the job with ``raise_error``.

    The conflict test rides along in the merge as a filter, so the check
    costs no extra pass over the data; the error surfaces when the result is
    computed. ``merge_conflicts`` lists the offending keys.
    """
    cols = _value_columns(a, b)
    sides, differs = _sides(a, b, cols)
    if validate:
        msg = F.concat(F.lit("datasets hold conflicting values for id "), F.col(ID), F.lit(" on "),
                       F.col(DATE).cast("string"))
        # a filter that is always true or fails: unlike a projected column it
        # is never pruned, so even count() checks every key
        sides = sides.filter(F.when(differs, F.raise_error(msg)).otherwise(F.lit(True)))
    return sides.select(ID, DATE, *[F.coalesce(f"{c}_0", f"{c}_1").alias(c) for c in cols])


def key_overlaps(a: DataFrame, b: DataFrame) -> dict[str, tuple[int, int, int]]:
    """Per key column: how many values only ``a`` has, only ``b`` has, and both have. One job."""
    sides = []
    for df, bit in ((a, 1), (b, 2)):
        keys = F.array(F.struct(F.lit(ID).alias("key"), F.col(ID).cast("string").alias("value")),
                       F.struct(F.lit(DATE).alias("key"), F.col(DATE).cast("string").alias("value")))
        sides.append(df.select(F.inline(keys), F.lit(bit).alias("bit")))
    seen = sides[0].union(sides[1]).groupBy("key", "value").agg(F.bit_or("bit").alias("bits"))
    found = seen.groupBy("key").agg(*[F.count_if(F.col("bits") == k).alias(f"n{k}") for k in (1, 2, 3)]).collect()
    return {ID: (0, 0, 0), DATE: (0, 0, 0)} | {r.key: (r.n1, r.n2, r.n3) for r in found}


def merge_append(a: DataFrame, b: DataFrame, how: str = "date", validate: bool = True) -> DataFrame:
    """Append dates (``how='date'``, id sets must match) or lakes (``how='id'``,
    date sets must match) (J3). Keys present in both: the second panel wins.

    With ``validate`` one job compares the keys: differing sets are an error,
    dates (or lakes) in both panels a warning with their number. Of several
    rows of one key in one panel the greatest in column order counts.
    """
    cols = _value_columns(a, b)
    if how not in ("date", "id_geohash", "id"):
        raise MergeError("how must be 'both', 'date' or 'id_geohash'")
    same, added = (ID, DATE) if how == "date" else (DATE, ID)
    if validate:
        found = key_overlaps(a, b)
        if found[same][0] or found[same][1]:
            raise MergeError(f"to merge by {how} both panels need one set of {same} values; {found[same][0]} are "
                             f"in the first alone, {found[same][1]} in the second")
        if found[added][2]:
            warnings.warn(f"{found[added][2]} {added} values are in both panels: the second panel's rows count",
                          stacklevel=2)
    both = (a.select(ID, DATE, *cols, F.lit(0).alias("_prio"))
             .unionByName(b.select(ID, DATE, *cols, F.lit(1).alias("_prio"))))
    # partial-aggregated before the shuffle
    picked = both.groupBy(ID, DATE).agg(F.max(F.struct("_prio", *cols)).alias("_v"))
    return picked.select(ID, DATE, *[F.col(f"_v.{c}").alias(c) for c in cols])


def merge_panels(a: DataFrame, b: DataFrame, how: str = "both", validate: bool = True) -> DataFrame:
    if how == "both":
        return merge_both(a, b, validate)
    return merge_append(a, b, how, validate)
