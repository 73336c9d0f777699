"""Measurement tables and prediction logs from delimited files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REQUIRED = ("em", "iso", "hb_cap", "flex")
# Normalised, lower-case header -> column; the first one present is taken.
_ALIASES = {
    "em": ("em",),
    "iso": ("around_n5_isoelectricpoint", "around_n5_isoelectric_point"),
    "hb_cap": ("around_n5_hbondcap", "around_n5_nh_bonds"),
    "flex": ("around_n5_flexibility",),
    "pdb_id": ("pdb_id",),
    "uniprot_id": ("uniprot_id",),
    "cofactor": ("cofactor",),
    "nearest_resname": ("n5_nearest_resname",),
}
_DEFAULTS = {"pdb_id": "DATASET", "uniprot_id": "UNK", "cofactor": "FMN",
             "nearest_resname": "UNK"}


def normalise_header(name: str) -> str:
    """Every run of other characters becomes one underscore."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")


def with_normal_headers(frame: DataFrame) -> DataFrame:
    return frame.toDF(*(normalise_header(c) for c in frame.columns))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               header: bool = True) -> DataFrame:
    """CSV with malformed rows dropped; text columns unless a schema is given."""
    reader = spark.read.option("header", header).option("mode", "DROPMALFORMED")
    if schema is not None:
        reader = reader.schema(schema)
    return with_normal_headers(reader.csv(path))


def safe_read_table(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """As :func:`read_table`, but an unreadable path gives an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return read_table(spark, path, schema, header)
    except AnalysisException:
        return with_normal_headers(spark.createDataFrame([], schema))


def as_measurements(raw: DataFrame) -> DataFrame:
    """Map known headers to the measurement columns and fill default ids."""
    frame = with_normal_headers(raw)
    present = {c.lower(): c for c in reversed(frame.columns)}
    source = {name: next((present[a] for a in options if a in present), None)
              for name, options in _ALIASES.items()}
    missing = [c for c in REQUIRED if source[c] is None]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    columns = [F.col(source[c]).try_cast("double").alias(c) for c in REQUIRED]
    for name, default in _DEFAULTS.items():
        value = F.col(source[name]).cast("string") if source[name] else F.lit(None)
        columns.append(F.coalesce(value, F.lit(default)).alias(name))
    return frame.select(*columns)


def load_measurements(spark: SparkSession, *paths: str) -> DataFrame:
    """First candidate path that holds a usable, non-empty table."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            frame = as_measurements(read_table(spark, path))
        except (AnalysisException, ValueError):
            continue
        if not frame.isEmpty():
            return frame
    raise FileNotFoundError(f"no usable table among: {', '.join(paths)}")
