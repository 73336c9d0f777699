"""Scoring, beam search and ranking of mutation combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C, hashing, mutation_exprs as M, scoring
from ..session import checkpoint
from .extremes import extreme_rows


def _ordering() -> list[Column]:
    return [F.round("total_score", 9).desc(), F.col("run_key")]


def top_per_group(frame: DataFrame, keys: list[str], k: int,
                  number: str = "rank") -> DataFrame:
    """Best ``k`` rows per group; the limit is applied before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*_ordering())
    return frame.withColumn(number, F.row_number().over(window)).where(
        F.col(number) <= k)


def score_singles(candidates: DataFrame, confidence: float = 50.0,
                  baseline: float = 0.0, burial: Column | None = None,
                  cofactor: str = "FMN") -> DataFrame:
    """Heuristic recommendation per candidate; burial counts zero by default."""
    level = F.lit(0.0) if burial is None else burial
    wt, mut = F.col("wt"), F.col("mut")
    one = F.array(F.struct(
        F.col("chain").alias("chain"), F.col("resi").alias("resseq"),
        F.col("icode").alias("icode"), wt.alias("wt"), mut.alias("mut")))
    scored = candidates.select(
        "structure_id", one.alias("mutations"),
        scoring.brightness_gain(mut).alias("delta_brightness"),
        F.lit(0.0).alias("synergy"),
        scoring.clash_risk(mut, level).alias("clash_risk"),
        scoring.stability_risk(wt, mut, level).alias("stability_risk"))
    return _finish(scored, confidence, baseline, cofactor)


def _finish(states: DataFrame, confidence: float, baseline: float,
            cofactor: str) -> DataFrame:
    return (
        states
        .withColumn("pred_brightness", F.lit(float(baseline)) + F.col("delta_brightness"))
        .withColumn("confidence", F.lit(float(confidence)))
        .withColumn("total_score", scoring.total_score(
            F.col("delta_brightness"), F.col("clash_risk"), F.col("stability_risk"),
            F.lit(float(confidence)), F.col("synergy")))
        .withColumn("run_key", hashing.run_key(
            F.col("structure_id").cast("string"), F.lit(cofactor), F.col("mutations")))
        .withColumn("heuristic", F.lit(True))
    )


def expand_beam(parents: DataFrame, singles: DataFrame, confidence: float = 50.0,
                baseline: float = 0.0, cofactor: str = "FMN",
                dedupe: bool = True) -> DataFrame:
    """All one-step extensions of the parents at unused positions.

    Both sides hold a fixed number of rows per structure (beam width and
    top-n), so the join is linear in the structures.
    """
    extra = singles.select(
        "structure_id", F.get("mutations", F.lit(0)).alias("_m"),
        F.col("delta_brightness").alias("_d"), F.col("clash_risk").alias("_c"),
        F.col("stability_risk").alias("_s"))
    used = F.exists("mutations", lambda m: (
        (m["chain"] == F.col("_m.chain")) & (m["resseq"] == F.col("_m.resseq"))
        & (m["icode"] == F.col("_m.icode"))))
    base = F.col("delta_brightness") + F.col("_d")
    grown = parents.join(extra, "structure_id").where(~used).select(
        "structure_id",
        F.array_sort(F.array_append("mutations", F.col("_m"))).alias("mutations"),
        (base + base * 0.1).alias("delta_brightness"),
        (base * 0.1).alias("synergy"),
        (F.col("clash_risk") + F.col("_c")).alias("clash_risk"),
        (F.col("stability_risk") + F.col("_s")).alias("stability_risk"))
    states = _finish(grown, confidence, baseline, cofactor)
    if not dedupe:
        return states
    # The same set can be reached in several orders; keep its best score.
    rest = [c for c in states.columns if c not in ("structure_id", "run_key", "total_score")]
    best = states.groupBy("structure_id", "run_key").agg(
        F.max(F.struct("total_score", *rest)).alias("b"))
    return best.select(
        "structure_id", *(F.col(f"b.{c}").alias(c) for c in rest), "b.total_score", "run_key"
    ).select(*states.columns)


def beam_levels(singles: DataFrame, max_size: int = C.MAX_COMBO_SIZE,
                beam_width: int = C.BEAM_WIDTH, **options) -> dict[int, DataFrame]:
    """Beam per combination size; size one is the best of the singles.

    Every level is read by the next one and by the caller.  It is a handful of
    rows per structure at the end of a long plan, so each is checkpointed; the
    singles are read by all levels, so they should be cut from their plan too.
    """
    levels = {1: top_per_group(singles, ["structure_id"], beam_width).drop("rank")}
    for size in range(2, max_size + 1):
        grown = expand_beam(levels[size - 1], singles, **options)
        best = top_per_group(grown, ["structure_id"], beam_width).drop("rank")
        levels[size] = checkpoint(best) if size < max_size else best
    return levels


def recommend(candidates: DataFrame, top_n: int = C.TOP_N,
              max_size: int = C.MAX_COMBO_SIZE, beam_width: int = C.BEAM_WIDTH,
              **options) -> DataFrame:
    """Ranked recommendations of every size for every structure."""
    singles = checkpoint(top_per_group(
        score_singles(candidates, **options), ["structure_id"], top_n).drop("rank"))
    levels = beam_levels(singles, max_size, beam_width, **options)
    out = singles.withColumn("size", F.lit(1))
    for size in range(2, max_size + 1):
        out = out.unionByName(levels[size].withColumn("size", F.lit(size)))
    return top_per_group(out, ["structure_id", "size"], top_n)


def to_rows(recommendations: DataFrame) -> DataFrame:
    """Output row: tokens joined by ``;`` and the public column names."""
    tokens = F.array_join(F.transform("mutations", M.canonical_token), ";")
    return recommendations.select(
        "structure_id", "size", "rank", tokens.alias("mutations"), "total_score",
        "pred_brightness", "delta_brightness", "synergy", "clash_risk",
        "stability_risk", "confidence", "run_key", "heuristic")


def prefer_computed(recommendations: DataFrame, keys: list[str],
                    show_heuristic: bool = True) -> DataFrame:
    """Computed rows of a group, or its heuristic rows when it has none."""
    flags = recommendations.groupBy(*keys).agg(
        F.bool_or(~F.col("heuristic")).alias("_computed"))
    keep = (F.col("heuristic") != F.col("_computed"))
    if not show_heuristic:
        keep = keep & ~F.col("heuristic")
    return recommendations.join(flags, keys).where(keep).drop("_computed")


def quick_picks(recommendations: DataFrame, per_size: int = 3) -> DataFrame:
    """First rows of each size with one running rank per structure."""
    first = top_per_group(
        recommendations.where(~F.col("heuristic")).drop("rank"),
        ["structure_id", "size"], per_size)
    # At most three rows per size are left, so this group is bounded.
    running = Window.partitionBy("structure_id").orderBy("size", "rank")
    return first.withColumn("pick", F.row_number().over(running))


def first_result_per_key(results: DataFrame, key: str = "run_key",
                         order: str = "seq", value: list[str] = ()) -> DataFrame:
    """Repeat the first result of a key on all its rows, as a cache would."""
    value = list(value)
    first = extreme_rows(results.select(key, order, *value), key, order, largest=False)
    return results.drop(*value).join(first.drop(order), key)


def is_flat_response(results: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose results do not differ: fall back to the heuristic.

    Distinct values are compared by their extremes, so the aggregation keeps
    no set: at most one value is left when minimum and maximum agree.
    """
    shown = F.bround("pred_brightness", 6)
    hashes = F.nullif(F.col("feature_hash"), F.lit(""))
    grouped = results.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.min(shown) == F.max(shown), F.lit(True)).alias("one_brightness"),
        F.coalesce(F.min(hashes) == F.max(hashes), F.lit(True)).alias("one_hash"),
        F.bool_and(F.abs(F.coalesce("delta_brightness", F.lit(0.0))) < 1e-9).alias("no_delta"))
    return grouped.select(*keys, (
        (F.col("n") >= 2) & F.col("one_brightness") & F.col("one_hash")
        & F.col("no_delta")).alias("flat"))
