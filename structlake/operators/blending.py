"""Blending of model outputs, driven by one-row statistics.

Statistics enter as scalar subqueries: each is one aggregation whose single
row becomes a literal of the outer stage, so no join is planned for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C, rules
from .quantiles import exact_quantiles


def one_row(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct column for another plan."""
    return stats.select(F.struct("*")).scalar()


def training_stats(train: DataFrame) -> DataFrame:
    """Means and population deviations of the features and predictions."""
    columns = ("em", "iso", "hb_cap", "flex", "gpr_pred_raw", "gpr_sigma")
    return train.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns),
        *(F.stddev_pop(c).alias(f"{c}_sd") for c in columns))


def success_stats(train: DataFrame) -> DataFrame:
    """Statistics of rows the baseline predicts well; zero when there is none."""
    good = F.abs(F.col("em") - F.col("gpr_pred_raw")) < C.BENCHMARK_ACCURACY
    names = {"flex": "flex", "hb_cap": "hb_cap", "gpr_sigma": "sigma"}
    def of(fn, c):
        return F.coalesce(fn(F.when(good, F.col(c))), F.lit(0.0))
    return train.agg(
        F.count_if(good).alias("n_success"),
        *(of(F.avg, c).alias(f"{n}_mean") for c, n in names.items()),
        *(of(F.stddev_pop, c).alias(f"{n}_sd") for c, n in names.items()),
        F.coalesce(F.avg(F.when(good, F.col("em"))), F.avg("gpr_pred_raw")).alias("em_mean"))


def with_complexity(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Add complexity, damping, the shrunk prediction and escalation."""
    s = F.col("_stats")
    score = rules.complexity(F.col("iso"), F.col("hb_cap"), F.col("flex"),
                             s.iso_mean, s.iso_sd, s.hb_cap_mean, s.hb_cap_sd)
    return (
        rows.withColumn("_stats", one_row(training_stats(train)))
        .withColumn("complexity", score)
        .withColumn("damping", rules.damping(F.col("complexity")))
        .withColumn("gpr_pred", rules.shrink_outlier(
            F.col("gpr_pred_raw"), s.gpr_pred_raw_mean, s.gpr_pred_raw_sd))
        .withColumn("gpr_mean", s.gpr_pred_raw_mean)
        .withColumn("escalate", rules.should_escalate(F.col("complexity"), F.col("gpr_sigma")))
        .drop("_stats"))


def with_quantum_weight(rows: DataFrame, train: DataFrame,
                        is_failure: Column) -> DataFrame:
    """Add the applicability-domain flag and the quantum weight."""
    median = one_row(exact_quantiles(train, ["gpr_sigma"], [0.5])).gpr_sigma[0]
    s = F.col("_success")
    inside = (
        rules.within_half_sd(F.col("flex"), s.flex_mean, s.flex_sd)
        & rules.within_half_sd(F.col("hb_cap"), s.hb_cap_mean, s.hb_cap_sd)
        & rules.within_half_sd(F.col("gpr_sigma"), s.sigma_mean, s.sigma_sd))
    return (
        rows.withColumns({"_success": one_row(success_stats(train)), "_median": median})
        .withColumn("in_domain", inside)
        .withColumn("quantum_weight", rules.quantum_weight(
            F.col("in_domain"), F.col("complexity"), F.col("gpr_sigma"),
            F.col("_median"), is_failure))
        .withColumn("success_em_mean", s.em_mean)
        .drop("_success", "_median"))


def worst_misses(train: DataFrame, k: int = C.WORST_MISSES) -> DataFrame:
    """Upper-case ids of the ``k`` rows with the largest baseline errors, each id once."""
    return (
        train.select("pdb_id", F.abs(F.col("em") - F.col("gpr_pred_raw")).alias("err"))
        .orderBy(F.desc("err"), "pdb_id").limit(k)
        .select(F.upper(F.col("pdb_id").cast("string")).alias("id_upper")).distinct())


def route(rows: DataFrame, train: DataFrame, evaluating: bool = False) -> DataFrame:
    """Tier routing of prepared rows with ``pred_8q`` and ``pred_16q``.

    The list of misses has a fixed length, so it is broadcast.  Ids may repeat
    and differ in case: each row stays one row.
    """
    misses = worst_misses(train).withColumn("is_miss", F.lit(True))
    marked = rows.withColumn("id_upper", F.upper(F.col("pdb_id").cast("string"))).join(
        F.broadcast(misses), "id_upper", "left").drop("id_upper")
    routed = rules.routed_prediction(
        F.col("gpr_pred"), F.col("pred_16q"), F.col("pred_8q"), F.col("flex"),
        F.col("complexity"), F.col("gpr_sigma"),
        F.coalesce("is_miss", F.lit(False)), F.col("success_em_mean"),
        F.col("gpr_mean"), F.col("quantum_weight"),
        F.col("em") if evaluating else None)
    return marked.withColumns(routed).drop("is_miss")


def with_fallback(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Blend in the local model where the regression collapsed."""
    high = one_row(exact_quantiles(train, ["gpr_sigma"], [0.75])).gpr_sigma[0]
    mean_em = one_row(train.agg(F.avg("em").alias("em"))).em
    with_mean = rows.withColumns({"_mean_em": mean_em, "_high": high})
    value, used = rules.fallback_blend(
        F.col("gpr_pred_raw"), F.col("local_pred"), F.col("gpr_sigma"),
        F.col("_mean_em"), F.col("_high"))
    return with_mean.withColumns(
        {"gpr_blended": value, "gpr_fallback_used": used}).drop("_mean_em", "_high")


def with_prior(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Blend with the mean of measurements of the same accession.

    Rows of the same cofactor are preferred where the accession has any.
    """
    accession = F.upper(F.col("uniprot_id").cast("string"))
    keyed = train.select(accession.alias("_acc"), F.upper("cofactor").alias("_cof"), "em")
    same_cofactor = keyed.groupBy("_acc", "_cof").agg(
        F.sum("em").alias("s"), F.count("em").alias("n"))
    # The accession level is summed from the finer one: no second pass.
    any_cofactor = same_cofactor.groupBy("_acc").agg(
        (F.sum("s") / F.sum("n")).alias("prior_any"))
    exact = same_cofactor.select("_acc", "_cof", (F.col("s") / F.col("n")).alias("prior_same"))
    prior = F.coalesce("prior_same", "prior_any")
    return (
        rows.withColumns({"_acc": accession, "_cof": F.upper("cofactor")})
        .join(exact, ["_acc", "_cof"], "left")
        .join(any_cofactor, "_acc", "left")
        .withColumn("prior_em", prior)
        .withColumn("gpr_prior", rules.prior_blend(
            F.col("gpr_pred_raw"), F.col("gpr_sigma"), F.col("prior_em")))
        .withColumn("prior_used", F.col("prior_em").isNotNull())
        .drop("_acc", "_cof", "prior_same", "prior_any"))


def align_features(rows: DataFrame, geometry: DataFrame, train: DataFrame) -> DataFrame:
    """Move geometry features to the training distribution."""
    names = ("iso", "hb_cap", "flex")
    geo = geometry.agg(*(f(c).alias(f"{c}_{t}") for c in names
                         for f, t in ((F.avg, "mean"), (F.stddev_pop, "sd"))))
    staged = rows.withColumns({"_geo": one_row(geo), "_train": one_row(training_stats(train))})
    return staged.withColumns({
        c: rules.align(F.col(c), F.col(f"_geo.{c}_mean"), F.col(f"_geo.{c}_sd"),
                       F.col(f"_train.{c}_mean"), F.col(f"_train.{c}_sd"))
        for c in names}).drop("_geo", "_train")
