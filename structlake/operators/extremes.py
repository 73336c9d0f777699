"""Rows that hold the extreme order value of their key.

``max`` over a struct has no fixed-width buffer, so Spark sorts the whole table
for it.  Here the extreme of the order value alone is folded by hash
aggregation, and a semi-join on key *and* value keeps the rows that hold it.
The value is part of the join's key, so the rows of a heavy key spread over
tasks by their values; only the few with the extreme value meet it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _same(left: str, right: str) -> Column:
    return F.col(f"`{left}`").eqNullSafe(F.col(f"`{right}`"))


def extreme_rows(frame: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
                 largest: bool | Sequence[bool] = True) -> DataFrame:
    """Rows with the largest (or smallest) ``order`` of their key; null keys are a key, null orders lose.

    With several order columns the later ones break ties of the earlier.  Rows
    that tie in all of them stay.  The frame is read once per order column and
    once more, so a long plan is best checkpointed before.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    orders = [order] if isinstance(order, str) else list(order)
    directions = [largest] * len(orders) if isinstance(largest, bool) else list(largest)
    out = frame
    for name, high in zip(orders, directions, strict=True):
        fold = F.max if high else F.min
        held = [f"_k{n}" for n in range(len(keys))]
        best = out.groupBy(*(F.col(f"`{k}`").alias(h) for k, h in zip(keys, held))).agg(
            fold(F.col(f"`{name}`")).alias("_best")).where(F.col("_best").isNotNull())
        # Plain equality on the value: an equi-join key that spreads a heavy key.
        on = F.col(f"`{name}`") == F.col("_best")
        for k, h in zip(keys, held):
            on = on & _same(k, h)
        out = out.join(best, on, "left_semi")
    return out
