"""The prediction cascade: each step works on the value that the one before hands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from . import blending


def predict(rows: DataFrame, train: DataFrame, is_failure: Column | None = None, single: bool = False,
            evaluating: bool = False) -> DataFrame:
    """Profile rows from model outputs and measured features.

    The local model replaces a collapsed regression, then measurements of the
    same accession pull the value, then outliers shrink, and the tier is
    chosen by complexity and weight.  ``rows`` carries ``gpr_pred_raw``,
    ``gpr_sigma``, ``local_pred``, ``pred_8q``, ``pred_16q``, ``st_gap`` and the
    features; ``train`` gives all statistics.  ``single`` calibrates the value
    of a single structure instead of the batch value.  Statistics are taken
    once per step, as scalar subqueries.  Failures are the known ones by
    ``pdb_id`` unless a flag is given.
    """
    if is_failure is None:
        is_failure = rules.is_known_failure(F.col("pdb_id"))
    blended = blending.with_fallback(rows, train).withColumn("gpr_pred_raw", F.col("gpr_blended"))
    pulled = blending.with_prior(blended, train).withColumn("gpr_pred_raw", F.col("gpr_prior"))
    weighted = blending.with_quantum_weight(
        blending.with_complexity(pulled, train), train, is_failure)
    routed = blending.route(weighted, train, evaluating)
    final, quantum, base = F.col("pred_final"), F.col("pred_q_used"), F.col("gpr_pred")
    if single:
        out = routed.withColumns({
            "pred_final": rules.final_single(final, quantum, base, F.col("prior_used")),
            "tier": rules.calibrated_tier(F.col("tier"))})
    else:
        out = routed.withColumn("pred_final", rules.final_batch(final, quantum, base, F.col("st_gap")))
    return out.withColumn("coupling_label", rules.coupling_label(
        F.col("st_gap"), F.col("n5_spin"), F.col("hfcc_primary"))).drop("gpr_blended", "gpr_prior")
