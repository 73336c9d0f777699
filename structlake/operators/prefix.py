"""Running numbers and sums over an order, without a single-task sort.

A window with no partition, or one partitioned by a heavy key, puts all rows
of the group in one task.  Here the rows are range-partitioned by the whole
order (so a heavy key is cut into several ranges), each range is processed on
its own, and the totals of the earlier ranges are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint


def running(frame: DataFrame, order: list[Column], keys: list[str] = (),
            value: str | None = None, number: str = "position",
            total: str = "running_total") -> DataFrame:
    """Add the position in the order per key, and the running sum of a value.

    ``order`` must be a total order inside a key.  The range assignment is
    sampled, so it is fixed by a checkpoint before it is read twice; rows per
    key in the offsets table are at most the number of ranges.
    """
    keys = list(keys)
    by_key = [F.col(k) for k in keys]
    ranged = checkpoint(
        frame.repartitionByRange(*by_key, *order)
        .withColumn("_range", F.spark_partition_id()))
    measures = [F.count("*").alias("_n")]
    if value:
        measures.append(F.sum(value).alias("_v"))
    totals = ranged.groupBy(*keys, "_range").agg(*measures)
    before = Window.partitionBy(*by_key).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0")] if value else []))
    inside = Window.partitionBy(*by_key, "_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, [*keys, "_range"]).withColumn(
        number, (F.row_number().over(inside) + F.col("_n0")).cast("bigint"))
    if value:
        out = out.withColumn(total, F.sum(value).over(upto) + F.col("_v0"))
    return out.drop("_range", "_n0", "_v0")
