"""Recommendations from evaluated results."""

import pytest
from pyspark.sql import functions as F

from structlake.operators import evaluated, recommend

RESULT = "run_key string, seq bigint, pred_brightness double, brightness_pred double, st_gap double, pred_final double, " \
         "clash_penalty double, triad_score double, scs double, feature_hash string, wavefunction_signature string"


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(s, "A", str(r), " ", wt, mut) for s in ("s", "flat", "none") for r, wt, mut in
            ((1, "A", "V"), (2, "K", "R"), (3, "P", "H"), (4, "G", "W"))]
    return spark.createDataFrame(rows, "structure_id string, chain string, resi string, icode string, wt string, mut string")


def result(key, bright=None, gap=None, final=None, hash_="h", seq=1, clash=0.0, sure=60.0):
    return (key, seq, bright, None, gap, final, clash, 0.0, sure, hash_, None)


def keys_of(pool):
    """Run key by structure and position."""
    return {(r.structure_id, r.mutations[0].resseq): r.run_key for r in recommend.score_singles(pool).collect()}


def test_levels_requests_and_fallbacks(spark, pool):
    key = keys_of(pool)
    wild = {r.structure_id: r.run_key for r in evaluated.unmutated_runs(pool).collect()}
    given = [result(wild["s"], 80.0, hash_="wt", gap=0.1), result(key["s", "1"], 90.0, gap=0.1, hash_="a", seq=1),
             result(key["s", "1"], 95.0, gap=0.3, hash_="a2", seq=2), result(key["s", "2"], final=-70.0, hash_="b"),
             result(key["s", "3"], -3.0), result(key["s", "4"], gap=0.35, hash_="d", clash=100.0),
             result(wild["flat"], 50.0, hash_="w"), *(result(key["flat", p], 50.0, hash_="same") for p in "124")]
    results = spark.createDataFrame(given, RESULT)
    rows, open_sets = evaluated.recommend_evaluated(pool, results)
    rows = rows.collect()
    singles = {r.run_key: r for r in rows if r.structure_id == "s" and r["size"] == 1}
    assert set(singles) == {key["s", p] for p in "124"}
    one = singles[key["s", "1"]]
    assert (one.pred_brightness, one.delta_brightness, one.feature_hash) == (95.0, 15.0, "a2|st:0.300000|stshift")
    assert singles[key["s", "2"]].notes.endswith("brightness proxy") and singles[key["s", "4"]].pred_brightness == 150.0
    assert {r.structure_id: r.notes for r in rows if r["size"] == 1 and r.heuristic and r["rank"] == 1} == {
        "flat": "Conservative substitution; heuristic gain applied. (computed-flat-response)",
        "none": "Conservative substitution; heuristic gain applied. (no-computed-singles)"}
    asked = open_sets.groupBy("structure_id", "size").count().collect()
    # Of "s" all singles are answered; its three pairs and one triple of answered singles are asked for.
    assert {(r.structure_id, r["size"]): r["count"] for r in asked} == {
        ("flat", 1): 1, ("none", 1): 4, ("s", 2): 3, ("s", 3): 1, ("flat", 2): 3, ("flat", 3): 1}
    answers = open_sets.where("structure_id = 's'").select(
        "run_key", F.lit(1).cast("bigint").alias("seq"), F.lit(99.0).alias("pred_brightness"), *(F.lit(None).cast("double").alias(c) for c in (
            "brightness_pred", "st_gap", "pred_final", "clash_penalty", "triad_score", "scs")), F.col("run_key").alias("feature_hash"),
        F.lit(None).cast("string").alias("wavefunction_signature"))
    rows, open_sets = evaluated.recommend_evaluated(pool, results.unionByName(answers))
    assert open_sets.where("structure_id = 's'").count() == 0
    sizes = {r["size"]: (r["count"], r.b) for r in rows.where("structure_id = 's'").groupBy("size").agg(
        F.count("*").alias("count"), F.max("pred_brightness").alias("b")).collect()}
    assert sizes == {1: (3, 150.0), 2: (3, 99.0), 3: (1, 99.0)}


def test_a_changed_volume_with_the_wild_type_features_is_rejected(spark, pool):
    key = keys_of(pool)
    wild = {r.structure_id: r.run_key for r in evaluated.unmutated_runs(pool).collect()}
    results = spark.createDataFrame([result(wild["s"], 80.0, hash_="wt"), *(result(key["s", p], 81.0, hash_="wt") for p in "1234")], RESULT)
    rows, _ = evaluated.recommend_evaluated(pool, results, max_size=1)
    kept = {r.run_key for r in rows.where("structure_id = 's'").collect()}
    # K2R changes little; proline to histidine changes hybridisation, the others their volume.
    assert kept == {key["s", "2"]}
    assert rows.where("structure_id = 's'").first().feature_hash.endswith("_collision")


def test_refusals(spark, pool):
    known = spark.createDataFrame([("s",), ("bare",), ("empty",)], "structure_id string")
    sites = spark.createDataFrame([("s", 1), ("empty", 2)], "structure_id string, n int")
    got = {tuple(r) for r in evaluated.refusals(known, sites, pool).collect()}
    assert got == {("bare", "no-flavin-detected"), ("empty", "no-candidates")}
