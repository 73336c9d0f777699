"""Writers.  Spark's commit protocol replaces locks and temporary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.jsonio import json_text


def append_log(frame: DataFrame, path: str, expected: list[str] | None = None) -> None:
    """Append to a log after checking that the expected columns are there."""
    _check(frame, expected)
    frame.write.mode("append").parquet(path)


def write_batch(frame: DataFrame, path: str, batch_id: int, expected: list[str] | None = None) -> None:
    """One micro-batch of a log; written again under the same number it replaces itself."""
    _check(frame, expected)
    frame.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _check(frame: DataFrame, expected: list[str] | None) -> None:
    missing = set(expected or ()) - set(frame.columns)
    if missing:
        raise ValueError(f"missing expected columns: {', '.join(sorted(missing))}")


def read_log(spark, path: str) -> DataFrame:
    """The log with the union of the columns of all its appends."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def overwrite_table(frame: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = frame.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)


def write_json_lines(frame: DataFrame, path: str) -> None:
    """One JSON object per row, missing values as null."""
    frame.select(json_text(F.struct("*")).alias("value")).write.mode(
        "overwrite").text(path)


def csv_text(*columns: str):
    """One CSV line per row as a column, for single-profile exports."""
    return F.to_csv(F.struct(*columns))
