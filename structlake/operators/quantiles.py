"""Exact quantiles of columns of any size, in one pass and without a driver step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import finite
from .prefix import running


def exact_quantiles(frame: DataFrame, columns: list[str],
                    probabilities: list[float]) -> DataFrame:
    """One row with an array of linear-interpolation quantiles per column.

    All columns go through one long table (column, value): equal values are
    counted, the counts summed along the range-partitioned order, and the
    wanted ranks picked from it.  No task holds a column, and size changes
    nothing.  NULL, NaN and infinite values are left out; a column without a
    value has NULL quantiles.  Numbering checkpoints the counts, so building
    this frame runs a job.
    """
    long = frame.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("c"), finite(F.col(c).cast("double")).alias("v"))
        for i, c in enumerate(columns)))).alias("x")).select("x.c", "x.v").where(F.col("v").isNotNull())
    counted = long.groupBy("c", "v").agg(F.count("*").alias("n"))
    upto = running(counted, [F.col("v").asc()], keys=["c"], value="n", total="upto")
    ranked = upto.join(upto.groupBy("c").agg(F.max("upto").alias("total")), "c")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    picked = ranked.groupBy("c").agg(F.max("total").alias("total"), *(
        at(edge(F.lit(float(p)) * (F.col("total") - 1))).alias(f"{side}{k}")
        for k, p in enumerate(probabilities) for side, edge in (("low", F.floor), ("high", F.ceil))))
    values = [F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}"))
              * (F.lit(float(p)) * (F.col("total") - 1) - F.floor(F.lit(float(p)) * (F.col("total") - 1)))
              for k, p in enumerate(probabilities)]
    wide = picked.select("c", *(v.alias(f"q{k}") for k, v in enumerate(values)))
    return wide.agg(*(
        F.array(*(F.max(F.when(F.col("c") == i, F.col(f"q{k}"))) for k in range(len(probabilities)))).alias(c)
        for i, c in enumerate(columns)))
