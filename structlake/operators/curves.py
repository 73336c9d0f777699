"""Summaries of yield curves kept as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dealt import CROWD, join_group


def spike_metrics(curves: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Amplitude and the angles of maximum and minimum, first angle on ties.

    Two hash aggregations with primitive buffers: the extremes, then the first
    angle at each of them.  A curve with very many points is dealt over tasks.
    """
    ends = curves.groupBy("curve_id").agg(
        F.max("phi").alias("high"), F.min("phi").alias("low"), F.count("*").alias("_n"))
    at = join_group(curves, ends, ["curve_id"], ["theta"], "_n", crowd)

    def first_at(value: str):
        return F.min(F.when(F.col("phi").eqNullSafe(F.col(value)), F.col("theta")))

    return at.groupBy("curve_id").agg(
        (F.max("high") - F.min("low")).alias("spike_amp"),
        first_at("high").alias("theta_at_max"), first_at("low").alias("theta_at_min"))


def closure_error(curves: DataFrame, phi_s: str = "phi_s", phi_t: str = "phi_t") -> DataFrame:
    """Largest deviation of the two yields from unity."""
    return curves.groupBy("curve_id").agg(
        F.max(F.abs(F.col(phi_s) + F.col(phi_t) - 1.0)).alias("closure_error"))


def centred(curves: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Anisotropic part: yield minus the mean of its curve.

    The means are aggregated first and joined back, a curve with very many
    points in parts, so it is not gathered in one task as a window would do.
    """
    means = curves.groupBy("curve_id").agg(F.avg("phi").alias("_mean"), F.count("*").alias("_n"))
    return join_group(curves, means, ["curve_id"], ["theta"], "_n", crowd).withColumn(
        "phi_centred", F.col("phi") - F.col("_mean")).drop("_mean")
