"""Dense positions inside groups without a one-task window.

``row_number().over(Window.partitionBy(g).orderBy(k))`` puts each group in
one task; a group holding a third of the rows then runs on one core. Here
the rows are range-partitioned by (group, order key), numbered inside each
range partition, and shifted by the row count of the earlier partitions of
the same group.

The numbered rows are written once (a reliable checkpoint in the shared
folder). Sizes and result are both read from that copy: planned twice, a
range exchange samples twice and its two sets of boundaries differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def dense_position(df: DataFrame, group: list[str], order: list, name: str = "position",
                   partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its group, in ``order``.

    ``order`` must be a total order (end it with a unique key).
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                          spark.sparkContext.defaultParallelism)
    order_cols = [c if isinstance(c, Column) else F.col(c) for c in order]
    group_cols = [F.col(g) for g in group]
    ranged = df.repartitionByRange(n, *group_cols, *order_cols).withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *group).orderBy(*order_cols)
    numbered = cut_lineage(ranged.withColumn("_rn", F.row_number().over(local)))
    sizes = numbered.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_pid") if group else Window.orderBy("_pid")
    offsets = sizes.select(F.col("_pid").alias("_opid"), *[F.col(g).alias(f"_g_{g}") for g in group],
                           (F.sum("_n").over(earlier) - F.col("_n")).alias("_off"))
    same = numbered["_pid"] == offsets["_opid"]
    for g in group:
        same = same & numbered[g].eqNullSafe(offsets[f"_g_{g}"])
    position = (F.col("_off") + F.col("_rn")).cast("long").alias(name)
    return numbered.join(offsets, same).select(*[numbered[c] for c in df.columns if c != name], position)
