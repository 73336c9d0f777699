"""Mutation lists, keys, hashes, validation, exclusions."""

import hashlib

from pyspark.sql import functions as F

from structlake.functions import hashing, mutation_exprs as M, rules, scoring
from structlake.operators import candidates, mutations, recommend


def parse(spark, text, chain=None):
    frame = spark.createDataFrame([(text,)], "raw string")
    row = mutations.parse_lists(frame, default_chain=F.lit(chain) if chain else None).first()
    return row.mutations, row.rejects


def test_parse_forms(spark):
    good, bad = parse(spark, "Q489K, A:V392A A:Q10AK", "B")
    assert [(m.chain, m.wt, m.resseq, m.icode, m.mut, m.chain_explicit) for m in good] == [
        ("A", "Q", "10", "A", "K", True), ("A", "V", "392", " ", "A", True), ("B", "Q", "489", " ", "K", False)]
    assert bad == []


def test_parse_rejects(spark):
    good, bad = parse(spark, "Z324R 12K q7 A:007 G007A")
    assert [(m.wt, m.resseq, m.mut) for m in good] == [("G", "7", "A")]
    assert [(r.raw, r.reason) for r in bad] == [
        ("Z324R", "not canonical"), ("12K", "missing wild type"), ("q7", "unparsable"), ("A:007", "unparsable")]


def test_keys_are_order_free_and_numeric(spark):
    frame = spark.createDataFrame([("A:Q100K A:V9A",), ("A:V9A,A:Q100K",), ("",), ("V9A B:C1D",)], "raw string")
    rows = mutations.parse_lists(frame).select(
        M.canonical_key(F.col("mutations")).alias("k"), M.display_key(F.col("mutations")).alias("d"),
        hashing.run_key(F.lit("s"), F.lit("FMN"), F.col("mutations")).alias("r")).collect()
    assert rows[0].k == "A:V9A_A:Q100K" and rows[0] == rows[1]
    assert rows[2].k == "WT" and rows[2].d == "WT"
    assert rows[3].d == "V9A_B:C1D"
    assert len({r.r for r in rows}) == 3


def test_feature_hash_text(spark):
    value = spark.range(1).select(hashing.feature_hash(
        F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.5)), "salt").alias("h")).first().h
    assert value == hashlib.sha256(b"a:1.50000000|b:2.00000000|salt").hexdigest()


def test_shift_vector(spark):
    digest = hashlib.sha256(b"A:10K").digest()
    row = spark.range(1).select(*hashing.shift_vector(F.lit("A:10K"))).first()
    assert [round(v, 9) for v in row] == [round((b % 7 - 3) * 0.05, 9) for b in digest[:3]]


def test_validation_fills_chain_and_checks_wild_type(spark):
    index = spark.createDataFrame(
        [("s", "A", "10", " ", "GLN", 9), ("s", "B", "11", " ", "MSE", 2)],
        "structure_id string, chain string, resi string, icode string, resn string, atom_count long")
    sets = spark.createDataFrame([("s", 1, "Q10K B:M11A Q10BK A10V Q99K")], "structure_id string, set_id int, raw string")
    rows = mutations.validate(mutations.parse_lists(sets), index, ["set_id"]).collect()
    assert {r.raw: (r.chain, r.reason) for r in rows} == {
        "Q10K": ("A", None), "B:M11A": ("B", None), "Q10BK": ("A", None),
        "A10V": ("A", "wild type mismatch"), "Q99K": ("A", "residue not found")}


def test_exclusions(spark):
    rows = spark.createDataFrame([("s", "A", "50"), ("s", "B", "50"), ("s", "A", "75"), ("s", "B", "75")],
                                 "structure_id string, chain string, resi string")
    tokens = spark.createDataFrame([("s", "50"), ("s", "A:75"), ("s", " ")], "structure_id string, token string")
    left = mutations.exclude_positions(rows, tokens).collect()
    assert [(r.chain, r.resi) for r in left] == [("B", "75")]


def test_short_lists_equal_full_scoring(spark):
    """The literal short lists agree with scoring every choice."""
    rows = spark.range(21 * 3).select(
        F.substring(F.lit("ACDEFGHIKLMNPQRSTVWYX"), (F.col("id") % 21 + 1).cast("int"), F.lit(1)).alias("wt"),
        (F.col("id") / 21 * 4).cast("int").alias("burial"))
    full = rows.withColumn("mut", F.explode(scoring.allowed_substitutions(F.col("wt"), F.col("burial")))).select(
        "wt", "burial", "mut", F.round(scoring.candidate_score(
            F.col("wt"), F.col("mut"), F.lit(3.0), F.col("burial")), 9).alias("score")).collect()
    want = {}
    for r in full:
        want.setdefault((r.wt, r.burial), []).append((-r.score, r.mut))
    for r in rows.withColumn("best", scoring.best_choices(F.col("wt"), F.col("burial"), 3)).withColumn(
            "base", scoring.site_term(F.lit(3.0), F.col("burial"))).collect():
        got = [(-round(b.pair_score + r.base, 8), b.mut) for b in r.best]
        assert got == [(round(s, 8), m) for s, m in sorted(want[(r.wt, r.burial)])[:3]]


def singles(spark):
    rows = [("s", "A", str(i), " ", "G", mut) for i, mut in ((1, "K"), (2, "W"), (3, "V"), (3, "K"))]
    pool = spark.createDataFrame(rows, "structure_id string, chain string, resi string, icode string, wt string, mut string")
    return recommend.score_singles(pool)


def test_beam_uses_distinct_positions_and_sets(spark):
    levels = recommend.beam_levels(singles(spark), 3)
    for size in (2, 3):
        states = levels[size].collect()
        assert states
        for state in states:
            assert len({(m.chain, m.resseq, m.icode) for m in state.mutations}) == size
        assert len({s.run_key for s in states}) == len(states)
    doubled = recommend.expand_beam(levels[1], singles(spark), dedupe=False)
    assert doubled.count() == 2 * recommend.expand_beam(levels[1], singles(spark)).count()


def test_recommend_ranks_by_score(spark):
    pool = spark.createDataFrame(
        [("s", "A", "1", " ", "A", "K"), ("s", "A", "2", " ", "A", "V")],
        "structure_id string, chain string, resi string, icode string, wt string, mut string")
    rows = recommend.to_rows(recommend.recommend(pool, max_size=2)).orderBy("size", "rank").collect()
    assert [(r.size, r.mutations) for r in rows] == [(1, "A:A1K"), (1, "A:A2V"), (2, "A:A1K;A:A2V")]
    assert rows[0].total_score == 3.0 + 0.3 * 50


def test_flat_response_and_preference(spark):
    rows = spark.createDataFrame(
        [("f", 1, False, 5.0, "h", 0.0), ("f", 1, False, 5.0000000001, "h", 0.0), ("g", 1, False, 5.0, "h", 0.0),
         ("g", 1, True, 6.0, "k", 1.0), ("h", 1, True, 1.0, "", 0.0)],
        "structure_id string, size int, heuristic boolean, pred_brightness double, feature_hash string, delta_brightness double")
    flat = {r.structure_id: r.flat for r in recommend.is_flat_response(rows, ["structure_id"]).collect()}
    assert flat == {"f": True, "g": False, "h": False}
    kept = recommend.prefer_computed(rows, ["structure_id", "size"]).groupBy("structure_id").count().collect()
    assert {r.structure_id: r["count"] for r in kept} == {"f": 2, "g": 1, "h": 1}
    assert recommend.prefer_computed(rows, ["structure_id", "size"], show_heuristic=False).where(
        "structure_id = 'h'").count() == 0


def test_brightness_cascade(spark):
    frame = spark.createDataFrame(
        [(1, 7.0, 0.35, -3.0), (2, None, 0.35, -3.0), (3, None, 9.0, -3.0), (4, -1.0, None, None), (5, None, None, None)],
        "i int, stated double, gap double, pred double")
    value, note = rules.brightness([F.col("stated")], F.col("gap"), F.col("pred"))
    rows = frame.select("i", value.alias("v"), note.alias("n")).collect()
    assert [(r.v, r.n) for r in rows] == [
        (7.0, ""), (150.0, "derived_from_st_gap"), (3.0, "emission_proxy"), (-1.0, "UNIT_MIXUP_BUG"),
        (None, "BRIGHTNESS_MISSING")]


def test_close_cysteine(spark):
    rows = spark.createDataFrame([("CYS", 3.9), ("CYS", 4.0), ("ALA", 1.0)], "resn string, min_dist double")
    assert candidates.protect_close_cysteine(rows).count() == 2
