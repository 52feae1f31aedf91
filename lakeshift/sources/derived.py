"""Lake-shaped tables derived by Spark from the driver's TPC-H-style tables.

Lakes do not exist in the test data, so every panel here is a deterministic
function of a real table and grows with it:

* ``planted_panel``  supplier x 60 months, closed-form areas with planted drops
* ``planted_jrc``    the same numbers laid out as a yearly JRC panel
* ``ship_panel``     lineitem quantities per supplier, ship month and class
* ``pixel_table``    events as classified pixels of ten lakes
* ``scene_table``    events as imagery scenes of the same lakes
* ``square_lakes``   one square polygon per customer

Integer formulas keep Spark and the DuckDB oracle bit-identical; every
double literal is written as a double (never a decimal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..family import DW_COLUMNS, ID
from ..functions.geohash import geohash_encode


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(key: Column, width: int = 6) -> Column:
    """Digits of ``key`` with zeros in front up to ``width``; longer keys stay whole."""
    text = key.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


N_MONTHS = 60
PANEL_START = "2017-01-01"
JRC_START_YEAR = 1962


def _planted_columns(k: Column, m: Column) -> dict[str, Column]:
    total = (F.lit(100) + (k % 7) * 10).cast("double")
    brk = F.when(k % 3 == 0, F.lit(20) + k % 20)
    base = F.when(brk.isNull() | (m < brk), F.lit(0.8)).otherwise(F.lit(0.3))
    share = base + ((k * 37 + m * 17) % 5).cast("double") * F.lit(0.005)
    water = total * share
    snow = total * F.when((k + m) % 12 == 0, F.lit(0.1)).otherwise(F.lit(0.01))
    bare = F.when((k + m * 5) % 23 == 0, F.lit(0.0)).otherwise(total - water - snow)
    return {"total": total, "water": water, "snow": snow, "bare": bare}


def planted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DW panel: one lake per supplier, 60 monthly dates from 2017-01."""
    sup = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = sup.select("k", F.explode(F.sequence(F.lit(0), F.lit(N_MONTHS - 1))).alias("m"))
    c = _planted_columns(F.col("k"), F.col("m"))
    zero = F.lit(0.0)
    vals = {name: zero for name in DW_COLUMNS}
    vals.update(water=c["water"], bare=c["bare"], snow_and_ice=c["snow"])
    return rows.select(
        F.concat(F.lit("lk"), padded(F.col("k"))).alias(ID),
        F.add_months(F.lit(PANEL_START).cast("date"), F.col("m")).alias("date"),
        *[vals[name].alias(name) for name in DW_COLUMNS],
    )


def planted_jrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JRC twin: permanent = water, seasonal = snow, land = bare; yearly from 1962."""
    sup = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = sup.select("k", F.explode(F.sequence(F.lit(0), F.lit(N_MONTHS - 1))).alias("m"))
    c = _planted_columns(F.col("k"), F.col("m"))
    return rows.select(
        F.concat(F.lit("lk"), padded(F.col("k"))).alias(ID),
        F.make_date(F.lit(JRC_START_YEAR) + F.col("m"), F.lit(1), F.lit(1)).alias("date"),
        c["bare"].alias("area_land"),
        c["snow"].alias("area_water_seasonal"),
        c["water"].alias("area_water_permanent"),
    )


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DW-shaped panel from lineitem: supplier x ship month, class = partkey % 9.

    Missing (supplier, month, class) cells are 0 ha. Totals vary a lot month
    to month, so this panel is prepared with ``nodata_max=1.0``.
    """
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    grouped = li.select(
        F.concat(F.lit("sp"), padded(F.col("l_suppkey"))).alias(ID),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"),
        (F.col("l_partkey") % 9).cast("int").alias("cls"),
        "l_quantity",
    )
    # conditional sums instead of pivot(): one partial/final aggregate, one shuffle
    return grouped.groupBy(ID, "date").agg(*[
        F.coalesce(F.sum(F.when(F.col("cls") == i, F.col("l_quantity"))), F.lit(0.0)).alias(name)
        for i, name in enumerate(DW_COLUMNS)])


# Event types of the test data mapped to label codes, in
# alphabetical order of the type name.
EVENT_LABELS = ("click", "error", "purchase", "signup", "view")


def event_label(col: Column) -> Column:
    expr = F.lit(None).cast("int")
    for i, name in enumerate(EVENT_LABELS):
        expr = F.when(col == name, F.lit(i)).otherwise(expr)
    return expr


def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(id_geohash, pixel_id, ts, label, pixel_area_m2) from events."""
    ev = _table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    return ev.select(
        F.concat(F.lit("px"), padded(F.col("user_id") % 10)).alias(ID),
        F.col("user_id").alias("pixel_id"),
        F.col("ts"),
        event_label(F.col("event_type")).alias("label"),
        F.col("value").alias("pixel_area_m2"),
    )


def jrc_pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel table with its five labels folded into the four codes of the JRC classes."""
    return pixel_table(spark, sf_dir).withColumn("label", F.col("label") % 4)


def scene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenes(id_geohash, scene_id, time, cloud_pct, missing_red) from events."""
    ev = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ev.select(
        F.concat(F.lit("px"), padded(F.col("user_id") % 10)).alias(ID),
        F.concat(F.lit("sc"), F.col("event_id").cast("string")).alias("scene_id"),
        F.col("ts").alias("time"),
        (F.col("event_id") % 41).cast("double").alias("cloud_pct"),
        (F.col("event_id") % 7).alias("missing_red"),
    )


SQUARE_SIDE = 0.004


def square_corner(k: Column) -> tuple[Column, Column]:
    """Lower-left corner of key ``k``: (-165 + k*0.01, 60 + (k % 100)*0.05), and every 33,000 keys, where
    the longitude would pass 165, one of ten rows 0.005 degrees further north, then a band of five degrees.
    After five bands the 100 rows are dealt anew, one row further on.

    Corners differ for all keys below 165,000,000; beyond, the query fails.
    """
    lap = F.floor(k / F.lit(33000))
    x = F.lit(-165.0) + (k % 33000).cast("double") * F.lit(0.01)
    row = (k % 100 + F.floor(lap / F.lit(50))) % 100
    y = (F.lit(60.0) + row.cast("double") * F.lit(0.05) + (lap % 10).cast("double") * F.lit(0.005)
         + (F.floor(lap / F.lit(10)) % 5).cast("double") * F.lit(5.0))
    too_far = F.raise_error(F.lit("square lakes end at key 164999999")).cast("double")
    return x, F.when(k < 165000000, y).otherwise(too_far)


def square_lakes(spark: SparkSession, sf_dir: str, source: str = "customer") -> DataFrame:
    """One square lake per customer key k (or per supplier, for the planted panel).

    Corners from ``square_corner``, side 0.004; the id is the 12-character
    geohash of the centre (customer) or the planted panel's ``lk`` id
    (supplier); attributes from integer formulas.
    """
    if source == "customer":
        cu = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    else:
        cu = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    x0, y0 = square_corner(F.col("k"))
    x1 = x0 + F.lit(SQUARE_SIDE)
    y1 = y0 + F.lit(SQUARE_SIDE)
    ring = F.array(
        F.struct(x0.alias("x"), y0.alias("y")),
        F.struct(x1.alias("x"), y0.alias("y")),
        F.struct(x1.alias("x"), y1.alias("y")),
        F.struct(x0.alias("x"), y1.alias("y")),
        F.struct(x0.alias("x"), y0.alias("y")),
    )
    start = (F.lit(100) + (F.col("k") % 7) * 10).cast("double")
    end = start - ((F.col("k") % 5) * 3).cast("double")
    cx = x0 + F.lit(SQUARE_SIDE / 2)
    cy = y0 + F.lit(SQUARE_SIDE / 2)
    lake_id = geohash_encode(cy, cx, 12) if source == "customer" else \
        F.concat(F.lit("lk"), padded(F.col("k")))
    return cu.select(
        lake_id.alias(ID),
        F.col("k").alias("lake_key"),
        start.alias("Area_start_ha"),
        end.alias("Area_end_ha"),
        (end - start).alias("NetChange_ha"),
        ((end - start) / start * F.lit(100.0)).alias("NetChange_perc"),
        F.array(F.array(ring)).alias("rings"),
    )
