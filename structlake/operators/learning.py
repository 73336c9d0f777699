"""Regression with uncertainty, local regression and family clustering.

Training cost is linear in the rows everywhere: what reaches the driver are
Gram matrices of fixed size, tree nodes, or two centroids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from .blending import one_row

FEATURES = ("iso", "hb_cap", "flex")
#: Length scales that a feature may have, in units of its deviation.
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: Matrices that one task adds.
FAN_IN = 16
#: Rows of equal features that a forest keeps apart.
BLOCKS = 4


def standardise(rows: DataFrame, train: DataFrame | None = None,
                features=FEATURES) -> DataFrame:
    """Add ``z_…`` columns with the population mean and deviation of training."""
    stats = (train if train is not None else rows).agg(*(
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features))
    scale = {c: F.when(F.col(f"_z.{c}.s") > 0, F.col(f"_z.{c}.s")).otherwise(F.lit(1.0))
             for c in features}
    return rows.withColumn("_z", one_row(stats)).withColumns({
        f"z_{c}": (F.col(c) - F.col(f"_z.{c}.m")) / scale[c] for c in features}).drop("_z")


@dataclass
class FourierRegression:
    """Bayesian linear regression on random Fourier features.

    Approximates a Gaussian process with a Matérn-3/2 kernel: frequencies are
    drawn from that kernel's spectral density, a Student t with three degrees
    of freedom (Rahimi and Recht, 2007).  Every feature has a length scale of
    its own; the longer it is, the less the feature counts.
    """

    center: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    covariance: np.ndarray
    noise_variance: float
    y_mean: float
    y_scale: float
    length_scales: tuple[float, ...] = ()

    def predict(self, rows: DataFrame, features=FEATURES, mean: str = "gpr_pred_raw",
                sigma: str = "gpr_sigma") -> DataFrame:
        """Add mean and predictive deviation; Arrow batches inside the tasks."""
        model = self

        @F.pandas_udf("mean double, sigma double")
        def apply(*columns: pd.Series) -> pd.DataFrame:
            basis = model.basis(np.column_stack(columns))
            spread = ((basis @ model.covariance) * basis).sum(axis=1)
            return pd.DataFrame({
                "mean": basis @ model.weights * model.y_scale + model.y_mean,
                "sigma": np.sqrt(spread + model.noise_variance) * model.y_scale})

        return rows.withColumn("_p", apply(*features)).withColumns(
            {mean: F.col("_p.mean"), sigma: F.col("_p.sigma")}).drop("_p")

    def basis(self, raw: np.ndarray) -> np.ndarray:
        scaled = (raw.astype(float) - self.center) / self.scale
        return _basis(scaled, self.frequencies, self.phases)


def _basis(scaled, frequencies, phases):
    # Single-precision cosines take about an eighth of the time; sums over them stay in double precision.
    angles = scaled @ frequencies + phases
    return np.multiply(np.cos(angles.astype(np.float32)), np.sqrt(2.0 / len(phases)), dtype=float)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all shuffle partitions: the work on a row is far dearer than its bytes, by which partitions are merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _folded(clean: DataFrame, moments, shape: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """Sum over all tasks of the arrays that ``moments`` makes of a batch, and the number of rows.

    A task gives one row with its array as bytes; rows meet by task number, so
    many at a time, until one is left.
    """
    columns = "task int, n double, total binary"

    def row(task: int, n: float, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"task": [task], "n": [n], "total": [total.tobytes()]})

    def local(batches):
        total, n = np.zeros(shape), 0.0
        for batch in batches:
            if len(batch):
                total += moments(batch)
                n += len(batch)
        yield row(TaskContext.get().partitionId(), n, total)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t).reshape(shape) for t in rows["total"])
        return row(int(rows["task"].iloc[0]) // FAN_IN, float(rows["n"].sum()), total)

    level = clean.mapInPandas(local, columns)
    tasks = clean.rdd.getNumPartitions()
    while tasks > 1:
        level = checkpoint(level.groupBy(F.floor(F.col("task") / FAN_IN).alias("block")).applyInPandas(add, columns))
        tasks = -(-tasks // FAN_IN)
    last = level.first()
    return (np.zeros(shape), 0.0) if last is None else (np.frombuffer(last.total).reshape(shape), last.n)


def fit_fourier(train: DataFrame, target: str = "em", features=FEATURES, size: int = 128,
                length_scales: tuple[float, ...] | None = None, seed: int = 42) -> FourierRegression:
    """Fit from Gram matrices summed over tasks, and small solves.

    Without given scales they are found by ascent on the evidence: every step
    folds the matrices of all sets that differ in one feature by one place of
    ``SCALES`` in one pass, and moves to the best.  Evidence rises with each
    step over a finite grid, so the ascent ends.
    """
    clean = checkpoint(_spread(train.select(*features, target).dropna()))
    names = [*features, target]
    row = clean.agg(*(F.avg(c).alias(f"m_{c}") for c in names),
                    *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    center = np.array([row[f"m_{c}"] or 0.0 for c in names])
    scale = np.array([row[f"s_{c}"] or 1.0 for c in names])
    rng = np.random.default_rng(seed)
    normal = rng.standard_normal((len(features), size)) / np.sqrt(rng.chisquare(3, size) / 3)
    phases = rng.uniform(0, 2 * np.pi, size)

    def solved(wanted: list[tuple[float, ...]]) -> dict:
        bases = [normal / np.array(w)[:, None] for w in wanted]

        def moments(batch: pd.DataFrame) -> np.ndarray:
            scaled = (batch[names].to_numpy(float) - center) / scale
            wides = (np.column_stack([_basis(scaled[:, :-1], f, phases), scaled[:, -1]]) for f in bases)
            return np.stack([wide.T @ wide for wide in wides])

        total, n = _folded(clean, moments, (len(wanted), size + 1, size + 1))
        return {w: _evidence(m[:-1, :-1], m[:-1, -1], m[-1, -1], n) for w, m in zip(wanted, total)}

    best = tuple(length_scales or (1.0,) * len(features))
    known = solved([best])
    while length_scales is None:
        places = [SCALES.index(s) for s in best]
        around = [best[:k] + (SCALES[p + step],) + best[k + 1:] for k, p in enumerate(places) for step in (-1, 1)
                  if 0 <= p + step < len(SCALES)]
        new = [w for w in around if w not in known]
        known |= solved(new) if new else {}
        top = max(known, key=lambda w: known[w][3])
        if top == best:
            break
        best = top
    weights, covariance, noise, _ = known[best]
    return FourierRegression(center[:-1], scale[:-1], normal / np.array(best)[:, None], phases, weights,
                             covariance, noise, float(center[-1]), float(scale[-1]), best)


def _evidence(gram, cross, square, n, rounds: int = 50):
    """Weights, covariance and noise by evidence maximisation on the moments, and the log evidence."""
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0, None)
    rotated = vectors.T @ cross
    prior, noise = 1.0, max(square / max(n, 1.0), 1e-6)
    for _ in range(rounds):
        precision = values / noise + prior
        mean = rotated / noise / precision
        effective = float(np.sum(values / noise / precision))
        residual = max(square - 2 * mean @ rotated + np.sum(values * mean * mean), 1e-12)
        prior = float(np.clip(effective / max(mean @ mean, 1e-12), 1e-3, 1e3))
        noise = float(np.clip(residual / max(n - effective, 1.0), 1e-4, 1e2))
    precision = values / noise + prior
    mean = rotated / noise / precision
    residual = max(square - 2 * mean @ rotated + np.sum(values * mean * mean), 0.0)
    evidence = 0.5 * (len(values) * np.log(prior) - n * np.log(2 * np.pi * noise) - residual / noise
                      - prior * mean @ mean - np.sum(np.log(precision)))
    return vectors @ mean, (vectors / precision) @ vectors.T, noise, float(evidence)


def _assembled(rows: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features",
                           handleInvalid="skip").transform(rows)


def _weighted(train: DataFrame, target: str, features) -> DataFrame:
    """Rows of equal features as up to ``BLOCKS`` rows with their mean target and, as ``_rows``, their number.

    Such rows fall into the same node of any tree, and the gain of a split is
    made of sums and counts alone, so means with weights give the same splits.
    The bootstrap draws a block as a whole; rows are dealt to blocks whatever
    their target is.  Up to ``BLOCKS`` equal rows it may draw apart, more are
    drawn in blocks.
    """
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(BLOCKS))
    return train.select(*features, target).dropna().withColumn("_block", block).groupBy(*features, "_block").agg(
        F.avg(target).alias(target), F.count("*").cast("double").alias("_rows")).drop("_block")


def fit_local_forest(train: DataFrame, target: str = "em", features=FEATURES,
                     trees: int = 300, depth: int = 8):
    """Random forest on all features per split, at least two rows per leaf.

    Every row carries a weight for each tree while the forest grows, so equal
    rows are merged first; and the rows are read several times, so their plan
    is cut.
    """
    rows = checkpoint(_weighted(train, target, features))
    total = rows.agg(F.sum("_rows")).first()[0] or 0.0
    # Weights are whole, so one and a half asks for two; the share has to stay below a half.
    forest = RandomForestRegressor(
        featuresCol="_features", labelCol=target, predictionCol="local_pred", weightCol="_rows",
        numTrees=trees, minInstancesPerNode=1, minWeightFractionPerNode=min(1.5 / max(total, 1.0), 0.49), maxDepth=depth,
        featureSubsetStrategy="all", maxMemoryInMB=1024, seed=42)
    return forest.fit(_assembled(rows, features))


def predict_local(model, rows: DataFrame, features=FEATURES) -> DataFrame:
    return model.transform(_assembled(rows, features)).drop("_features")


def name_families(rows: DataFrame, centroids: list[tuple[float, float]]) -> DataFrame:
    """Nearest of two centroids; the one with the lower first value is named
    nitroreductase."""
    def squared(c):
        return (F.col("iso") - c[0]) * (F.col("iso") - c[0]) + (
            F.col("hb_cap") - c[1]) * (F.col("hb_cap") - c[1])

    low, high = sorted(centroids)
    return rows.withColumn("family", F.when(
        squared(low) <= squared(high), "nitroreductase").otherwise("reductase"))


def _rested(places: DataFrame, features: tuple[str, str], start: str) -> tuple[list[tuple[float, ...]], float]:
    """Centroids after Lloyd steps from the means at or below, and above, the mean of one feature; and their spread."""
    weight = F.col("count")

    def folded(first, spread) -> list[tuple[float, ...]]:
        sides = {"low": first, "high": ~first}
        row = places.agg(*(F.struct(F.sum(F.when(test, weight)).alias("n"), *(
            F.sum(F.when(test, weight * F.col(f))).alias(f) for f in features)).alias(name) for name, test in sides.items()),
            F.sum(weight * spread).alias("spread")).first()
        return [tuple(row[name][f] / row[name].n for f in features) if row[name].n else None for name in sides], row.spread

    def squared(centre):
        return sum(((F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, centre)), F.lit(0.0))

    middle = places.agg(F.sum(weight * F.col(start)) / F.sum(weight)).first()[0]
    now, _ = folded(F.col(start) <= middle, F.lit(0.0))
    if None in now:
        now = [c or next(filter(None, now)) for c in now]
    while True:
        low, high = map(squared, now)
        moved, spread = folded(low <= high, F.least(low, high))
        moved = [m or c for m, c in zip(moved, now)]
        if np.allclose(moved, now, rtol=1e-12, atol=0.0):
            return now, spread
        now = moved


def two_means(rows: DataFrame, features: tuple[str, str] = ("iso", "hb_cap")) -> list[tuple[float, ...]]:
    """Two centroids: of the Lloyd descents from a cut at each feature's mean, the one with the least spread.

    Equal rows are counted once and for all, so a step is one aggregation over
    the distinct ones; two centroids are all that reaches the driver.
    """
    places = checkpoint(rows.select(*features).dropna().groupBy(*features).count())
    return min((_rested(places, features, f) for f in features), key=lambda found: found[1])[0]


def cluster_families(rows: DataFrame) -> DataFrame:
    """Two clusters on the first two features, named by their centroids."""
    if len(rows.select("iso", "hb_cap").dropna().head(2)) < 2:
        return rows.withColumn("family", F.lit("single_upload"))
    return name_families(rows, two_means(rows))
