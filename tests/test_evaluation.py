"""Blending rules, reports, quantiles, running sums, curves, models."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlake.functions import rules
from structlake.operators import blending, curves, evaluation, learning, prefix, quantiles


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_exact_quantiles(spark):
    rng = random.Random(1)
    # A third of the rows share one value.
    values = [rng.gauss(0, 100) for _ in range(2000)] + [7.5] * 1000
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = [float(np.quantile(values, p)) for p in (0.1, 0.5, 0.9)]
    got = quantiles.exact_quantiles(frame, ["v"], [0.1, 0.5, 0.9]).first().v
    assert got == pytest.approx(want, abs=1e-9)
    empty = spark.createDataFrame([], "v double")
    assert quantiles.exact_quantiles(empty, ["v"], [0.5]).first().v == [None]


def test_quantiles_leave_out_what_is_not_finite(spark):
    odd = [float("inf"), float("-inf"), float("nan"), None]
    frame = spark.createDataFrame([(v, 1.0) for v in [*map(float, range(41)), *odd]], "v double, w double")
    row = quantiles.exact_quantiles(frame, ["v", "w"], [0.5, 0.25]).first()
    assert (row.v, row.w) == ([20.0, 10.0], [1.0, 1.0])


def test_running_with_heavy_ties_and_keys(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "k%d" % (i % 7), i, 5 if i % 2 else rng.randint(0, 9)) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, i int, v long").repartition(6)
    got = {(r.k, r.i): (r.position, r.running_total) for r in prefix.running(
        frame, [F.col("v").desc(), F.col("i")], ["k"], value="v").collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for n, (k, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1])), 1):
            total += v
            assert got[(k, i)] == (n, total)


def test_confidence_scores_of_known_profiles(spark):
    lone = rules.confidence_score(F.lit("Non-Canonical Binding Pocket"), F.lit(12.81), F.lit(0.0), F.lit(0))
    assert one(spark, lone) == pytest.approx(45.0)
    bluf = rules.confidence_score(F.lit("BLUF-Type H-Bonding"), F.lit(3.0), F.lit(1 / 3), F.lit(3))
    assert one(spark, bluf) == pytest.approx(70 + 20 / 3 + 7.5)
    index = rules.sensitivity_index(F.lit(0.06484), F.lit(45.187), F.lit(0.01157))
    assert one(spark, index) == pytest.approx(253.2, abs=0.2)


def test_crossing_and_coupling(spark):
    assert one(spark, rules.crossing_detected(F.lit(0.005), F.lit(0.5))) is True
    assert one(spark, rules.crossing_detected(F.lit(None).cast("double"), F.lit(0.5))) is False
    label = rules.coupling_label(F.lit(0.005), F.lit(0.5), F.lit(20.0))
    assert one(spark, label) == "HIGH COUPLING"
    nan = rules.coupling_label(F.lit(float("nan")), F.lit(0.5), F.lit(20.0))
    assert one(spark, nan).startswith("COUPLING: UNKNOWN")


def test_nudge_needs_the_measured_value(spark):
    def route(truth):
        out = rules.routed_prediction(
            F.lit(-200.0), F.lit(-150.0), F.lit(-150.0), F.lit(1.2), F.lit(3.0), F.lit(50.0), F.lit(False),
            F.lit(-190.0), F.lit(-190.0), F.lit(0.05), truth)
        return spark.range(1).select(*(c.alias(n) for n, c in out.items())).first()
    assert route(None).pred_final == -200.0
    used = route(F.lit(-100.0))
    assert used.tier == "hybrid_8q" and used.pred_final > -200.0


def test_metrics_and_histogram(spark):
    rows = [(float(i), float(i) + (-1) ** i * (i % 5)) for i in range(101)]
    frame = spark.createDataFrame(rows, "em double, p double").withColumn("e", F.abs(F.col("em") - F.col("p")))
    got = evaluation.regression_metrics(frame, {"m": "p"}, {"all": F.lit(True)}).first()
    errors = [abs(a - b) for a, b in rows]
    mean = statistics.mean(a for a, _ in rows)
    r2 = 1 - sum(e * e for e in errors) / sum((a - mean) ** 2 for a, _ in rows)
    assert (got.mae, got.medae, got.r2) == pytest.approx((statistics.mean(errors), statistics.median(errors), r2))
    counts, edges = np.histogram([a for a, _ in rows], bins=30)
    bins = evaluation.histogram(frame, "em").orderBy("bin").collect()
    assert [b.n for b in bins] == counts.tolist()
    assert [b.left_edge for b in bins] == pytest.approx(edges[:-1].tolist())
    flat = evaluation.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").where("n > 0").collect()
    assert [(b.bin, b.n) for b in flat] == [(1, 3)]


def test_p_value(spark):
    # Known quantiles of Student's t, the Cauchy case, and many degrees of freedom.
    known = [(2.2281388519649385, 10, 0.05), (0.0, 28, 1.0), (1.0, 1, 0.5), (12.706204736432095, 1, 0.05), (-2.0422724563012373, 30, 0.05),
             (4.302652729911275, 2, 0.05), (1.9599639845400545, 10**9, 0.05), (40.0, 12, 3.8512295807720034e-14), (1e-8, 5, 1 - 7.592133e-9)]
    rows = spark.createDataFrame([(t, n + 2, p) for t, n, p in known], "t double, n bigint, p0 double").withColumn("r", F.lit(0.5))
    for row in evaluation.correlation_p(rows).collect():
        assert row.p == pytest.approx(row.p0, rel=2e-7 if row.n > 10**8 else 1e-9, abs=1e-18), row
    odd = spark.createDataFrame([(None, 9, None), (None, 9, -1.0), (None, 2, 1.0), (None, 1, None)], "t double, n bigint, r double")
    assert [r.p for r in evaluation.correlation_p(odd).collect()] == [None, 0.0, 1.0, None]


def test_guard_levels(spark):
    def guarded(error):
        frame = spark.createDataFrame([(0.0, error, 1.0, True), (0.0, error, 1.0, False)],
                                      "em double, pred_final double, gpr_pred double, bad boolean")
        return [r.pred_guarded for r in evaluation.global_guard(frame, F.col("bad")).collect()]
    assert guarded(50.0) == [1.0, 1.0]
    assert sorted(guarded(46.2)) == [1.0, 46.2]
    assert guarded(10.0) == [10.0, 10.0]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="iso"):
        evaluation.complete_rows(spark.range(1).withColumn("em", F.lit(1.0)), ["em", "iso"])


def test_prior_prefers_same_cofactor(spark):
    train = spark.createDataFrame([("P1", "FAD", -100.0), ("P1", "FMN", -300.0), ("P2", "FAD", -50.0)],
                                  "uniprot_id string, cofactor string, em double")
    rows = spark.createDataFrame([("p1", "fad"), ("P2", "FMN"), ("P3", "FAD")], "uniprot_id string, cofactor string"
                                 ).withColumns({"gpr_pred_raw": F.lit(0.0), "gpr_sigma": F.lit(200.0)})
    got = {r.uniprot_id: (r.prior_em, r.gpr_prior, r.prior_used) for r in blending.with_prior(rows, train).collect()}
    assert got == {"p1": (-100.0, pytest.approx(-85.0), True), "P2": (-50.0, pytest.approx(-42.5), True),
                   "P3": (None, 0.0, False)}


def test_spike_metrics_take_first_angle(spark):
    rows = [(1, float(t), p) for t, p in enumerate([0.2, 0.9, 0.1, 0.9, 0.1])]
    got = curves.spike_metrics(spark.createDataFrame(rows, "curve_id int, theta double, phi double")).first()
    assert (got.spike_amp, got.theta_at_max, got.theta_at_min) == (pytest.approx(0.8), 1.0, 2.0)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(6.0 + i, 1.0 + j, 1.1 + 0.1 * k, -300.0 + 20 * i - 15 * j + 40 * k)
            for i in range(8) for j in range(4) for k in range(3)]
    return spark.createDataFrame(rows, "iso double, hb_cap double, flex double, em double")


def test_fourier_regression_behaviour(spark, grid):
    model = learning.fit_fourier(grid)
    far = spark.createDataFrame([(500.0, 90.0, 30.0)], "iso double, hb_cap double, flex double")
    near = model.predict(grid).select("em", "gpr_pred_raw", "gpr_sigma").collect()
    assert statistics.mean(abs(r.em - r.gpr_pred_raw) for r in near) < 15
    spread = {round(r.gpr_pred_raw, 1) for r in near}
    assert len(spread) > 20
    assert model.predict(far).first().gpr_sigma > max(r.gpr_sigma for r in near)


def test_forest_and_families(spark, grid):
    model = learning.fit_local_forest(grid, trees=20)
    rows = learning.predict_local(model, grid).collect()
    assert statistics.mean(abs(r.em - r.local_pred) for r in rows) < 25
    split = spark.createDataFrame([(5.0, 1.0), (5.5, 1.2), (40.0, 4.0), (41.0, 4.2)], "iso double, hb_cap double")
    names = {r.iso: r.family for r in learning.cluster_families(split).collect()}
    assert names == {5.0: "nitroreductase", 5.5: "nitroreductase", 40.0: "reductase", 41.0: "reductase"}
    assert learning.cluster_families(split.limit(1)).first().family == "single_upload"


def test_routing_keeps_one_row_per_row(spark):
    rows = spark.createDataFrame(
        [("dataset", float(e), 0.0) for e in (1, 5, 9)] + [("Dataset", 7.0, 0.0), ("other", 0.0, 0.0)],
        "pdb_id string, em double, gpr_pred_raw double").withColumns({c: F.lit(1.0) for c in (
            "gpr_pred", "pred_16q", "pred_8q", "flex", "complexity", "gpr_sigma", "success_em_mean", "gpr_mean", "quantum_weight")})
    got = blending.route(rows, rows.where("em > 6")).collect()
    assert sorted((r.pdb_id, r.tier) for r in got) == [
        ("Dataset", "hybrid_16q"), *[("dataset", "hybrid_16q")] * 3, ("other", "uhf_16q_active")]


def test_success_contrast_reports_empty_groups(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0)], "e double, flex double, hb_cap double, gpr_sigma double")
    got = {r.group: (r.n, r.mean_sigma) for r in evaluation.success_contrast(rows, "e").collect()}
    assert got == {"success_lt36": (1, 3.0), "failure_gt80": (0, None)}


def test_an_irrelevant_feature_gets_the_longest_scale(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 3))
    y = np.sin(3 * x[:, 0]) + 0.3 * x[:, 1] + 0.05 * rng.normal(size=1200)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "iso double, hb_cap double, flex double, em double").repartition(40)
    model = learning.fit_fourier(rows)
    assert model.length_scales[2] == max(model.length_scales) and model.length_scales[0] == min(model.length_scales)
    fixed = learning.fit_fourier(rows, length_scales=(1.0, 1.0, 1.0))
    def error(m):
        return m.predict(rows).agg(F.avg(F.pow(F.col("em") - F.col("gpr_pred_raw"), 2))).first()[0]
    assert error(model) < error(fixed)


def test_two_means_rest(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal((10, 3), 1, (80, 2)), rng.normal((20, 6), 1, (40, 2))])
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in points] + [(None, 1.0)], "iso double, hb_cap double").repartition(7)
    low, high = sorted(learning.two_means(rows))
    near = ((points - low) ** 2).sum(1) <= ((points - high) ** 2).sum(1)
    assert np.allclose(points[near].mean(0), low) and np.allclose(points[~near].mean(0), high) and near.sum() == 80
    same = spark.createDataFrame([(1.0, 2.0)] * 3, "iso double, hb_cap double")
    assert learning.two_means(same) == [(1.0, 2.0), (1.0, 2.0)]


def test_long_curves_are_dealt(spark):
    rows = [("long", t, math.sin(t / 7)) for t in range(500)] + [("short", 0, 1.0), ("short", 1, 3.0), (None, 0, 2.0)]
    frame = spark.createDataFrame(rows, "curve_id string, theta int, phi double").where("curve_id IS NOT NULL")
    for crowd in (7, 100, 10_000):
        got = {r.curve_id: r for r in curves.spike_metrics(frame, crowd).collect()}
        assert got["short"].spike_amp == 2.0 and (got["short"].theta_at_max, got["short"].theta_at_min) == (1, 0)
        low, high = min(rows[:500], key=lambda r: (r[2], r[1])), max(rows[:500], key=lambda r: (r[2], -r[1]))
        assert (got["long"].theta_at_max, got["long"].theta_at_min) == (high[1], low[1])
        means = curves.centred(frame, crowd).groupBy("curve_id").agg(F.count("*").alias("n"), F.avg("phi_centred").alias("m")).collect()
        assert {r.curve_id: r.n for r in means} == {"long": 500, "short": 2} and all(abs(r.m) < 1e-12 for r in means)


def test_forest_merges_equal_rows(spark, monkeypatch):
    """Copies of rows add weight, not rows, and a leaf still has two rows."""
    taken = []
    fit = learning.RandomForestRegressor.fit
    monkeypatch.setattr(learning.RandomForestRegressor, "fit", lambda self, rows: taken.append(rows.count()) or fit(self, rows))
    once = spark.range(100).selectExpr("id * 1.0D AS iso", "id % 7 * 1.0D AS hb_cap", "id % 3 * 1.0D AS flex", "id % 10 * 1.0D AS em")
    copied = once.join(spark.range(20).select(F.col("id").alias("copy")), how="cross").drop("copy")
    learning.fit_local_forest(once, trees=2)
    learning.fit_local_forest(copied, trees=2)
    assert taken[0] == 100 and taken[1] <= 100 * learning.BLOCKS
    pair = spark.createDataFrame([(1.0, 1.0, 1.0, 5.0)] * 30 + [(2.0, 1.0, 1.0, 9.0)] * 30, "iso double, hb_cap double, flex double, em double")
    model = learning.fit_local_forest(pair, trees=40)
    assert {r.iso: round(r.local_pred, 1) > 7 for r in learning.predict_local(model, pair).collect()} == {1.0: False, 2.0: True}
