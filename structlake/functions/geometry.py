"""Distances and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cell indices are packed into one long, 21 bits per axis.
_AXIS_BITS = 21
_AXIS_BIAS = 1 << (_AXIS_BITS - 1)


def squared_distance(a: tuple, b: tuple) -> Column:
    dx, dy, dz = (F.col(p) - F.col(q) for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def distance(a: tuple, b: tuple) -> Column:
    return F.sqrt(squared_distance(a, b))


def cell_index(value: Column, edge: float) -> Column:
    return F.floor(value / F.lit(edge))


def pack_cell(ix: Column, iy: Column, iz: Column) -> Column:
    return (
        F.shiftleft(ix + F.lit(_AXIS_BIAS), 2 * _AXIS_BITS)
        + F.shiftleft(iy + F.lit(_AXIS_BIAS), _AXIS_BITS)
        + (iz + F.lit(_AXIS_BIAS))
    )


def axis_gap(value: Column, index: Column, edge: float) -> Column:
    """Distance on one axis from a coordinate to the cell with that index."""
    low = index * F.lit(edge)
    return F.greatest(low - value, value - low - F.lit(edge), F.lit(0.0))
