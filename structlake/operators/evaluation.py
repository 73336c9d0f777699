"""Evaluation reports over measured and predicted values."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C, tails, rules
from .blending import one_row
from .prefix import running
from .quantiles import exact_quantiles


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, population deviation and exact median per column."""
    medians = one_row(exact_quantiles(rows, columns, [0.5]))
    wide = rows.agg(*(F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("sd"),
    ).alias(c) for c in columns)).withColumn("_medians", medians)
    return wide.select(F.inline(F.array(*(
        F.col(c).withField("median", F.col("_medians")[c][0]) for c in columns))))


def regression_metrics(rows: DataFrame, models: dict[str, str],
                       subsets: dict[str, Column], truth: str = "em") -> DataFrame:
    """MAE, median error and R² of each model on each subset, in one pass.

    R² is one minus the mean squared error over the population variance, which
    merges centred moments and so needs no second pass for the mean.
    """
    prepared = rows.select(truth, *{
        f"_e_{m}_{s}": F.when(test, F.abs(F.col(truth) - F.col(c))).alias(f"_e_{m}_{s}")
        for m, c in models.items() for s, test in subsets.items()}.values(),
        *(F.when(test, F.col(truth)).alias(f"_t_{s}") for s, test in subsets.items()))
    names = [(m, s) for m in models for s in subsets]
    medians = one_row(exact_quantiles(prepared, [f"_e_{m}_{s}" for m, s in names], [0.5]))
    wide = prepared.agg(*(F.struct(
        F.lit(m).alias("model"), F.lit(s).alias("subset"),
        F.count(f"_e_{m}_{s}").alias("n"), F.avg(f"_e_{m}_{s}").alias("mae"),
        (1.0 - F.avg(F.col(f"_e_{m}_{s}") * F.col(f"_e_{m}_{s}"))
         / F.nullif(F.var_pop(f"_t_{s}"), F.lit(0.0))).alias("r2"),
    ).alias(f"{m}_{s}") for m, s in names)).withColumn("_medians", medians)
    return wide.select(F.inline(F.array(*(
        F.col(f"{m}_{s}").withField("medae", F.col("_medians")[f"_e_{m}_{s}"][0]) for m, s in names))))


def hit_counts(rows: DataFrame, baseline: str, final: str) -> DataFrame:
    """Hits under the two thresholds, improved share, mean reduction."""
    e = F.col(final)
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(e < C.BENCHMARK_ACCURACY).alias("hits_36"),
        F.count_if(e < C.CHEMICAL_ACCURACY).alias("hits_43"),
        (100.0 * F.avg((e < C.BENCHMARK_ACCURACY).cast("double"))).alias("pct_36"),
        (100.0 * F.avg((e < C.CHEMICAL_ACCURACY).cast("double"))).alias("pct_43"),
        (100.0 * F.avg((e < F.col(baseline)).cast("double"))).alias("improved_pct"),
        F.avg(F.col(baseline) - e).alias("mean_error_reduction"))


def success_contrast(rows: DataFrame, final: str) -> DataFrame:
    """Feature means of successes and failures, both always; rows in between are left out."""
    groups = {"success_lt36": F.col(final) < C.BENCHMARK_ACCURACY,
              "failure_gt80": F.col(final) > C.FAILURE_ERROR}
    means = {"mean_flexibility": "flex", "mean_hbondcap": "hb_cap", "mean_sigma": "gpr_sigma"}
    wide = rows.agg(*(F.struct(
        F.lit(name).alias("group"), F.count_if(test).alias("n"),
        *(F.avg(F.when(test, F.col(c))).alias(out) for out, c in means.items()),
    ).alias(name) for name, test in groups.items()))
    return wide.select(F.inline(F.array(*groups)))


def correlations(rows: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Pearson r with its t statistic; NULL without two values or spread."""
    entries = []
    for name, (a, b) in pairs.items():
        both = a.isNotNull() & b.isNotNull()
        left, right = F.when(both, a), F.when(both, b)
        # ``corr`` itself fails on a constant column in ANSI mode.
        spread = F.nullif(F.stddev_pop(left) * F.stddev_pop(right), F.lit(0.0))
        entries.append(F.struct(
            F.lit(name).alias("pair"), F.count(left).alias("n"),
            F.when(F.count(left) > 1, F.covar_pop(left, right) / spread).alias("r"),
        ).alias(name))
    wide = rows.agg(*entries).select(F.inline(F.array(*pairs)))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1.0 - F.col("r") * F.col("r"), F.lit(0.0)))
    return wide.withColumn("t", F.when(F.col("n") > 2, t))


def correlation_p(correlated: DataFrame) -> DataFrame:
    """Add ``p``, the two-sided p-value of the rows of :func:`correlations`.

    Two values always correlate, so their p is one; a perfect correlation of more has zero.
    """
    r, n = F.col("r"), F.col("n")
    tail = tails.student_two_sided(F.col("t"), n - 2)
    return correlated.withColumn("p", F.when(r.isNotNull() & (n == 2), 1.0).when(F.abs(r) >= 1, 0.0).otherwise(tail))


def magnetic_candidates(rows: DataFrame, gap: str, spin: str, spin2: str) -> DataFrame:
    """Flag rows in the low tail of the gap and the high tail of both spins."""
    cut = F.col("_cut")
    flag = ((F.col(gap) <= cut[gap][0]) & (F.col(spin) >= cut[spin][1])
            & (F.col(spin2) >= cut[spin2][1]))
    limits = one_row(exact_quantiles(rows, [gap, spin, spin2], [0.1, 0.9]))
    return rows.withColumn("_cut", limits).withColumn(
        "candidate", F.coalesce(flag, F.lit(False))).drop("_cut")


def join_flag(rows: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """Bring a flag back by id; rows without one are false."""
    slim = flags.groupBy(key).agg(F.bool_or(flag).alias(flag))
    return rows.join(slim, key, "left").na.fill(False, [flag])


def hit_miss_means(rows: DataFrame, error: str, value: str) -> DataFrame:
    hit = F.col(error) < C.CHEMICAL_ACCURACY
    return rows.agg(F.avg(F.when(hit, F.col(value))).alias("mean_hits"),
                    F.avg(F.when(~hit, F.col(value))).alias("mean_misses"))


def split_by_ids(rows: DataFrame, ids: DataFrame, key: str = "pdb_id"):
    """Rows whose id is listed, and the rest."""
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over the value range; the last bin is closed."""
    span = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    staged = rows.where(F.col(column).isNotNull()).select(
        column, one_row(span).alias("_span"))
    width = F.col("_span.high") - F.col("_span.low")
    index = F.when(width > 0, F.least(
        F.floor(F.lit(bins) * (F.col(column) - F.col("_span.low")) / width) + 1,
        F.lit(bins))).otherwise(F.lit(1))
    counted = staged.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edges = span.select("low", "high", F.explode(
        F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    step = (F.col("high") - F.col("low")) / bins
    return edges.join(counted, "bin", "left").select(
        "bin", (F.col("low") + (F.col("bin") - 1) * step).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"))


def top_rows(rows: DataFrame, by: Column, k: int, key: str = "pdb_id") -> DataFrame:
    """The ``k`` largest rows; ties by key, missing values last."""
    return rows.orderBy(by.desc_nulls_last(), key).limit(k)


def failures(rows: DataFrame, baseline: str, final: str, k: int = 10) -> DataFrame:
    bad = (F.col(baseline) > C.FAILURE_ERROR) & (F.col(final) > C.FAILURE_ERROR)
    return top_rows(rows.where(bad), F.col(final), k)


def major_divergence(failed: DataFrame, quantum: str, baseline: str) -> DataFrame:
    return failed.where(
        F.abs(F.col(quantum) - F.col(baseline)) > C.DIVERGENCE_ERROR)


def cumulative_error(rows: DataFrame, error: str, key: str = "pdb_id",
                     by: list[str] = ()) -> DataFrame:
    """Rank and running total of the errors, largest first."""
    return running(rows, [F.col(error).desc(), F.col(key)], list(by), value=error,
                   number="rank", total="cumulative_error")


def global_guard(rows: DataFrame, failure: Column, truth: str = "em",
                 final: str = "pred_final", baseline: str = "gpr_pred") -> DataFrame:
    """Fall back to the baseline when the mean error is too large.

    Beyond the lock every row reverts.  Below it, but beyond the second
    threshold, only the failure subset does.
    """
    mae = one_row(rows.agg(F.avg(F.abs(F.col(truth) - F.col(final))).alias("mae"))).mae
    staged = rows.withColumn("_mae", mae)
    locked = F.col("_mae") > C.MAE_LOCK
    revert = (F.col("_mae") > C.MAE_REVERT) & failure
    return staged.withColumns({
        "pred_guarded": F.when(locked | revert, F.col(baseline)).otherwise(F.col(final)),
        "lock_applied": locked,
    }).drop("_mae")


def complete_rows(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Drop rows with a missing required value; and the counts around it."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    whole = F.lit(True)
    for c in required:
        whole = whole & rules.finite(F.col(c)).isNotNull()
    counts = rows.agg(F.count("*").alias("n_before"), F.count_if(whole).alias("n_after"))
    return rows.where(whole), counts
