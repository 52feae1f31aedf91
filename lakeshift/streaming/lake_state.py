"""Per-lake state of a monthly stream: all that later months need of the history.

One row per lake: its largest total area, and of its dates those that can
still count, as an array of (date, water, total area, limited classes) in
order of time. A date whose total falls short of the largest area by more
than the rounding of the mask is masked now and for good, since the largest
area only grows; it is not kept. Everything else follows from the state and
the new rows exactly as from the whole panel: a larger area in a new month
rescales and remasks what is kept, and a late or corrected row takes its
place in the array.

A batch therefore joins its rows to the state by lake, once, and reads
nothing older. The state is written as a version per batch. The state before
batch k is the latest version below k, so a batch that is delivered again
starts from the same state and replaces its own version. Versions before the
last two are never read again and may be removed.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..family import DATE, ID, Family
from ..functions.numeric import round_even
from ..operators.forecast import FORECAST, forecast_of_series
from ..operators.nrt import _finish, with_month

#: A total that is lower than the largest by more than this rounds to a missing area.
SLACK = 1e-4
#: The version made from the first history.
FIRST = -1


def state_path(history_path: str) -> str:
    return f"{history_path.rstrip('/')}_state"


def row_of(family: Family) -> Column:
    """What the state keeps of one panel row; NULL where a class is missing, as such a row never counts."""
    total = None
    for c in family.sum_order:
        total = F.col(c) if total is None else total + F.col(c)
    limited = [F.col(c).cast("double") for c in family.limits]
    row = F.struct(F.col(DATE).alias("t"), F.col(family.water_col).cast("double").alias("w"),
                   total.cast("double").alias("a"),
                   (F.array(*limited) if limited else F.array().cast("array<double>")).alias("x"))
    return F.when(total.isNotNull(), row)


def grouped(panel: DataFrame, family: Family) -> DataFrame:
    """``(id, seen, rows)``: the dates of each lake and its rows that may count, in order of time.

    Of several rows of one date the greatest (in water, then area) counts.
    """
    rows = panel.filter(F.col(ID).isNotNull() & F.col(DATE).isNotNull()).select(ID, DATE, row_of(family).alias("row"))
    held = rows.groupBy(ID).agg(F.collect_set(DATE).alias("seen"), F.array_sort(F.collect_list("row")).alias("rows"))
    last = F.filter("rows", lambda r, i: ~F.coalesce(F.get("rows", i + 1)["t"] == r["t"], F.lit(False)))
    return held.select(ID, "seen", last.alias("rows"))


def merged(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """``(id, max_area, rows)`` of state and new rows together; a new row the kept one
    of its date, also by nothing."""
    if state is None:
        held = new.withColumn("max_area", F.lit(None).cast("double"))
        old = F.array().cast(new.schema["rows"].dataType)
    else:
        kept = state.select(F.col(ID).alias("_id"), "max_area", F.col("rows").alias("old"))
        held = new.join(kept, new[ID] == kept["_id"], "full").withColumn(ID, F.coalesce(ID, "_id")).drop("_id")
        old = F.coalesce(F.col("old"), F.array().cast(new.schema["rows"].dataType))
    fresh = F.coalesce(F.col("rows"), F.array().cast(new.schema["rows"].dataType))
    seen = F.coalesce(F.col("seen"), F.array().cast("array<date>"))
    rest = F.filter(old, lambda r: ~F.array_contains(seen, r["t"]))
    most = F.greatest(F.col("max_area"), F.array_max(F.transform(fresh, lambda r: r["a"])))
    return held.select(ID, most.alias("max_area"), F.array_sort(F.concat(rest, fresh)).alias("rows"))


def compacted(whole: DataFrame) -> DataFrame:
    """The state to keep: rows that a larger area has ruled out go."""
    keep = F.filter("rows", lambda r: r["a"] >= F.col("max_area") - SLACK)
    return whole.select(ID, "max_area", keep.alias("rows"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches that have a version, from the names of the folders."""
    try:
        files = spark.read.parquet(path).inputFiles()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({int(m[1]) for f in files if (m := re.search(r"/batch=(-?\d+)/", f))})


def state_before(spark: SparkSession, history_path: str, batch_id: int) -> DataFrame | None:
    """The state that batch ``batch_id`` starts from, or None if there is none."""
    path = state_path(history_path)
    known = [v for v in versions(spark, path) if v < batch_id]
    return spark.read.parquet(f"{path}/batch={known[-1]}") if known else None


def write_version(state: DataFrame, history_path: str, batch_id: int) -> None:
    state.write.mode("overwrite").parquet(f"{state_path(history_path)}/batch={batch_id}")


def analysed(whole: DataFrame, family: Family, months: list[str], forecast: str, orders: dict | None,
             min_length: int = 3) -> DataFrame:
    """NRT rows, with ``analysis_month`` and ``failed``, of every valid date in ``months`` of ``merged`` lakes.

    All lakes with such a date are analysed, also those that a batch brings
    nothing of: month files are replaced as a whole.
    """
    biggest = F.col("max_area")

    def valid(r: Column) -> Column:
        ok = round_even(biggest - r["a"], 4) / biggest <= 0.0
        for k, limit in enumerate(family.limits.values()):
            ok = ok & (r["x"][k] / biggest <= F.lit(float(limit)))
        return F.coalesce(ok, F.lit(False))

    lakes = whole.filter(biggest > 0).select(ID, biggest, F.filter("rows", valid).alias("rows"))
    lakes = lakes.withColumn("scale", F.array_max(F.transform("rows", lambda r: r["a"])))
    asked = F.filter("rows", lambda r: F.date_format(r["t"], "yyyy-MM").isin(months) & r["w"].isNotNull())
    each = lakes.select(ID, "scale", "max_area", "rows", F.explode(asked).alias("now"))
    earlier = F.filter("rows", lambda r: (r["t"] < F.col("now.t")) & r["w"].isNotNull())
    rows = each.select(ID, F.col("now.t").alias(DATE), (F.col("now.w") / biggest).alias("obs"), "scale",
                       F.transform(earlier, lambda r: r["w"] / biggest).alias("series"))
    found = forecast_of_series(rows, [ID, DATE, "obs", "scale"], forecast, min_length, stats=True, **(orders or {}))
    failed = F.col("forecast_error").isNotNull() | F.coalesce(F.isnan(FORECAST[0]), F.lit(False))
    found = found.withColumn("failed", failed)
    good = [F.when(~F.col("failed"), F.col(c)) for c in FORECAST]
    return with_month(_finish(found, F.col("obs"), *good, F.col(DATE), F.lit(True), ("failed",)))
