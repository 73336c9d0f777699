"""JSON text of rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import finite


def json_text(value: Column, keep_nulls: bool = True) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false" if keep_nulls else "true"})


def eigenvalue_payload(*values: Column) -> Column:
    """``{"eigenvalues": […]}`` with non-finite numbers as null."""
    return json_text(F.struct(F.array(*(finite(v) for v in values)).alias("eigenvalues")))
