"""Joins of rows to the one row of their group, with heavy groups dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a group that one task takes.
CROWD = 100_000


def join_group(rows: DataFrame, groups: DataFrame, keys: list[str], place: list[str], count: str,
               crowd: int = CROWD) -> DataFrame:
    """``rows`` with the columns of their row of ``groups``, whose ``count`` says how many rows it has.

    A group with more than ``crowd`` rows is cut into as many parts as it needs
    by a hash of ``place``, and its row is repeated for each.  The list of such
    groups has at most one entry per ``crowd`` rows.
    """
    parts = F.ceil(F.col(count) / crowd).cast("int")
    heavy = groups.where(F.col(count) > crowd).select(*keys, parts.alias("_parts"))
    dealt = rows.join(heavy, keys, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(*place), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    repeated = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated, [*keys, "_part"]).drop("_part", count)
