"""Report views over panels and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..family import DATE, ID
from .panel import add_area

# Classes merged into "vegetation" in the long view.
VEGETATION = ("flooded_vegetation", "grass", "shrub_and_scrub", "trees")


def to_long(df: DataFrame, group_vegetation: bool = True) -> DataFrame:
    """DW panel -> ``(id, date, variable, value)``.

    With ``group_vegetation`` the four vegetation classes become one
    ``vegetation`` variable (plain sum); variables: water, vegetation, crops,
    built, bare, snow_and_ice, area_nodata where present.
    """
    if group_vegetation:
        veg = None
        for c in VEGETATION:
            veg = F.col(c) if veg is None else veg + F.col(c)
        names = ["water", "vegetation", "crops", "built", "bare", "snow_and_ice"]
        df = df.withColumn("vegetation", veg)
    else:
        names = ["water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare",
                 "snow_and_ice"]
    if "area_nodata" in df.columns:
        names.append("area_nodata")
    return df.unpivot([ID, DATE], names, "variable", "value")


def to_long_jrc(df: DataFrame) -> DataFrame:
    """JRC panel -> long, with ``area_total = area_data + area_nodata``."""
    names = ["area_water_permanent", "area_water_seasonal", "area_land", "area_nodata", "area_total"]
    df = df.withColumn("area_total", F.col("area_data") + F.col("area_nodata"))
    return df.unpivot([ID, DATE], names, "variable", "value")


def pick_variables(long: DataFrame, names) -> DataFrame:
    """Keep chosen variables of a long table."""
    return long.filter(F.col("variable").isin(list(names)))


def relative_percent(long: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """value / lake max area * 100 (P8); max from ``scale(id, max_area)`` or the
    lake's largest ``area_data + area_nodata`` in the long table."""
    if scale is None:
        w = Window.partitionBy(ID)
        mx = F.max(F.when(F.col("variable") == "area_total", F.col("value"))).over(w)
        return long.withColumn("value_pct", F.try_divide(F.col("value"), mx) * F.lit(100.0))
    return (long.join(scale, ID, "left")
                .withColumn("value_pct", F.try_divide(F.col("value"), F.col("max_area")) * F.lit(100.0))
                .drop("max_area"))


def relative_long(panel: DataFrame, group_vegetation: bool = True) -> DataFrame:
    """A raw panel as ``(id, date, variable, value, value_pct)`` (P6, P8): ``to_long`` with each value's share of
    the lake's largest total area, which one window adds before the rows are unpivoted."""
    whole = add_area(panel).drop("area_nodata", "area_data")
    if group_vegetation:
        veg = None
        for c in VEGETATION:
            veg = F.col(c) if veg is None else veg + F.col(c)
        whole = whole.withColumn("vegetation", veg)
        names = ["water", "vegetation", "crops", "built", "bare", "snow_and_ice"]
    else:
        names = ["water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare",
                 "snow_and_ice"]
    pairs = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("value")) for n in names])
    return whole.select(ID, DATE, "max_area", F.inline(pairs)).select(
        ID, DATE, "variable", "value", (F.try_divide("value", "max_area") * F.lit(100.0)).alias("value_pct"))


def compare_sources(dw_long: DataFrame, jrc_long: DataFrame) -> DataFrame:
    """Both families of the same lakes, tagged by ``source``."""
    return (dw_long.withColumn("source", F.lit("dynamic_world"))
                   .unionByName(jrc_long.withColumn("source", F.lit("jrc"))))


def series_with_break(df: DataFrame, breaks: DataFrame | None = None, break_date=None) -> DataFrame:
    """Series plus the lake's first break date (P10), or plus ``break_date`` for every lake.

    ``breaks(id, date_break[, break_number])``: the first break is the one
    with the smallest break number, else the earliest date.
    """
    if (breaks is None) == (break_date is None):
        raise ValueError("give breaks or break_date")
    if break_date is not None:
        return df.withColumn("first_break", F.lit(str(break_date)).cast("date"))
    order = F.struct(F.col("break_number") if "break_number" in breaks.columns else F.lit(0),
                     F.col("date_break"))
    first = breaks.groupBy(ID).agg(F.min_by("date_break", order).alias("first_break"))
    return df.join(first, ID, "left")


def ranked_drained(drained_rows: DataFrame) -> DataFrame:
    """Drained lakes of each month ranked from 1.

    By ``water_change_ha`` when present, else by ``water_residual``,
    ascending; the sort key column gets its report name.
    """
    cols = [c for c in ["id_geohash", "water_residual", "water_observed", "water_predicted", "date",
                        "water_change_ha", "water_change_perc"] if c in drained_rows.columns]
    key = "water_change_ha" if "water_change_ha" in drained_rows.columns else "water_residual"
    # rank inside each month without a one-task window per month
    from .ordering import dense_position
    out = dense_position(drained_rows.select("analysis_month", *cols), ["analysis_month"],
                         [F.col(key).asc_nulls_last(), F.col(ID)], "rank")
    out = out.withColumn("rank", F.col("rank").cast("int"))
    if key == "water_change_ha":
        out = (out.withColumnRenamed("water_change_ha", "Water Change [ha]")
                  .withColumnRenamed("water_change_perc", "Water Change [%]"))
    else:
        out = out.withColumnRenamed("water_residual", "Water Residual [%]")
    return out


def largest_lakes(lakes: DataFrame, n: int = 2000, by: str = "Area_start_ha") -> DataFrame:
    """Top ``n`` lakes by area (O1): a top-k, planned as TakeOrderedAndProject."""
    return lakes.orderBy(F.desc(by), F.col(ID)).limit(n)


def hide_stable(df: DataFrame, view: str = "historical") -> DataFrame:
    """Drop lakes without a break (historical) or with confidence NULL/0 (nrt)."""
    if view == "historical":
        return df.filter(F.col("date_break_year").isNotNull())
    return df.filter(F.coalesce(F.col("drainage_confidence"), F.lit(0)) > 0)


def pick_month(nrt: DataFrame, month: str) -> DataFrame:
    """One analysis month (F11); partition pruning when read from a month-partitioned table."""
    return nrt.filter(F.col("analysis_month") == F.lit(month))


def month_parts(df: DataFrame, col: str = "analysis_month") -> DataFrame:
    """Year and month integers from a ``YYYY-MM`` column (M5)."""
    return (df.withColumn("year", F.substring(col, 1, 4).cast("int"))
              .withColumn("month", F.substring(col, 6, 2).cast("int")))
