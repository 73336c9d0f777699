"""Hard negatives by the threshold algorithm over sorted lists of components.

A score is the integer inner product of an anchor with a row.  The rows are
dealt by hash into blocks of about ``BLOCK``, the anchors into parts of about
``PART``, and every part meets every block in a task group of its own.  A block
lists its rows by each component.  For an anchor the lists are read from the
end that the sign of its component favours, all to the same depth; each row met
for the first time is looked up and scored whole.  No row still unseen can
score above the threshold, the score of the components last read, so reading
stops once the threshold is strictly below the last score that each search
keeps (strictly, as ties go to the smaller id).

Two searches follow each other: the best rows of the anchor's label are its
positives, and their scores set the windows in which rows of other labels are
its hard negatives.  A block hands on its best few of each search, and the best
of these over all blocks are the result, which is exact.

Defined cases: rows with a null id or label, a null vector or a null or
non-finite component take no part; rows that repeat an id, a label and all
components count once; a vector ends in zeros where others are longer;
components are held within 2 ** 28 either way, so that sums stay exact; an anchor
without another row of its label has no positives and no result; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint

#: Rows of a block and anchors of a part, on average.
BLOCK, PART = 8192, 2048
#: Places of every list that the first round reads; each further round reads twice as many.
STEP = 64
POSITIVES, NEGATIVES = 5, 3
#: A negative scores from LOW to HIGH hundredths of its positive.
LOW, HIGH = 50, 95
HOLD = 1 << 28


def integer_rows(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
                 scale: int = 256) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (floors of the scaled components), ``mark`` of all rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * scale, F.lit(-float(HOLD))), F.lit(float(HOLD)))).cast("int"))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), scaled.alias("vector")
    ).distinct().withColumn("mark", F.xxhash64("vec_id", "label", "vector"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, zeros where they end earlier."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors):
        row[:len(vector)] = vector
    return out


class Block:
    """Rows with a list of their places for every component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.upward = np.argsort(vectors, axis=0, kind="stable")

    def accesses(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rounds of sorted access: places met first, their scores, and the threshold for all others."""
        n, dims = len(self.ids), np.flatnonzero(anchor)
        if not len(dims):
            yield np.arange(n), np.zeros(n, np.int64), -np.inf
            return
        weight, unseen = anchor[dims], np.ones(n, bool)
        fall = weight > 0
        depth, step = 0, STEP
        while depth < n:
            end = min(n, depth + step)
            rows = np.where(fall, self.upward[n - end:n - depth, dims], self.upward[depth:end, dims])
            met = np.zeros(n, bool)
            met[rows] = True
            met &= unseen
            unseen ^= met
            places = np.flatnonzero(met)
            last = np.where(fall, self.upward[n - end, dims], self.upward[end - 1, dims])
            threshold = float(weight @ self.vectors[last, dims]) if unseen.any() else -np.inf
            yield places, self.vectors[places] @ anchor, threshold
            if threshold == -np.inf:
                return
            depth, step = end, 2 * step


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, ties by rising id."""
    if len(scores) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]],
           k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (from, to) the first ``k`` allowed rows with 100 times the score inside it."""
    none = np.zeros(0, np.int64)
    kept = [(none, none) for _ in windows]
    for places, scores, threshold in block.accesses(anchor):
        places, scores = places[allowed[places]], scores[allowed[places]]
        open_windows = False
        for w, (low, high) in enumerate(windows):
            inside = (100 * scores >= low) & (100 * scores <= high)
            ids, own = kept[w]
            kept[w] = ids, own = best(np.append(ids, block.ids[places[inside]]), np.append(own, scores[inside]), k)
            done = low > high or 100 * threshold < low or (len(own) == k and threshold < own[-1])
            open_windows |= not done
        if not open_windows:
            break
    return kept


def _positives_of_block(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *map(len, anchors["vector"]), *map(len, rows["vector"])])
        vectors, labels = matrix(rows["vector"], width), rows["label"].to_numpy()
        ids, marks = rows["vec_id"].to_numpy(), rows["mark"].to_numpy()
        found = []
        for label, group in anchors.groupby("label"):
            own = np.flatnonzero(labels == label)
            block, own_marks = Block(ids[own], vectors[own]), marks[own]
            for anchor, row in zip(matrix(group["vector"], width), group.itertuples()):
                others = (block.ids != row.vec_id) | (own_marks != row.mark)
                near, scores = search(block, anchor, others, [(-np.inf, np.inf)], k)[0]
                found.append(pd.DataFrame({"anchor_id": row.vec_id, "mark": row.mark, "id": near, "score": scores}))
        columns = ["anchor_id", "mark", "id", "score"]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)
    return run


def _negatives_of_block(k: int, low: int, high: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *map(len, anchors["vector"]), *map(len, rows["vector"])])
        block, labels = Block(rows["vec_id"].to_numpy(), matrix(rows["vector"], width)), rows["label"].to_numpy()
        found = []
        for anchor, row in zip(matrix(anchors["vector"], width), anchors.itertuples()):
            windows = [(low * p["score"], high * p["score"]) for p in row.positives]
            for p, (near, scores) in zip(row.positives, search(block, anchor, labels != row.label, windows, k)):
                found.append(pd.DataFrame({
                    "anchor_id": row.vec_id, "mark": row.mark, "place": p["place"], "positive_id": p["id"],
                    "positive_score": p["score"], "id": near, "score": scores}))
        columns = ["anchor_id", "mark", "place", "positive_id", "positive_score", "id", "score"]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)
    return run


def _first(found: DataFrame, keys: list[str], k: int, place: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Hard negatives of the anchors among ``rows``, as ``integer_rows`` gives them."""
    rows = checkpoint(rows)
    chosen = rows.where(is_anchor)
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).first()
    blocks, parts = max(1, ceil(size.n / block)), max(1, ceil(size.anchors / part))
    hashed = F.col("mark")
    dealt = rows.withColumn("block", F.pmod(hashed, F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).groupBy("part", "block")

    def meet(anchors: DataFrame):
        spread = anchors.withColumn("part", F.pmod(hashed, F.lit(parts))).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        # Renamed to themselves, so that its columns are not those of ``rows``.
        return spread.toDF(*spread.columns).groupBy("part", "block").cogroup(dealt)

    near = _first(meet(chosen).applyInPandas(
        _positives_of_block(positives), "anchor_id bigint, mark bigint, id bigint, score bigint"),
        ["anchor_id", "mark"], positives, "place")
    # At most ``positives`` entries each.
    listed = near.groupBy(F.col("anchor_id").alias("vec_id"), "mark").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    aimed = chosen.join(listed, ["vec_id", "mark"])
    found = meet(aimed).applyInPandas(
        _negatives_of_block(negatives, low, high),
        "anchor_id bigint, mark bigint, place int, positive_id bigint, positive_score bigint, id bigint, score bigint")
    return _first(found, ["anchor_id", "mark", "place"], negatives, "rank").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def hard_negative_report(embeddings: DataFrame) -> DataFrame:
    """One row per anchor, positive and hard negative; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_rows(embeddings.select("vec_id", moved.alias("label"), "embedding"))
    return mine(rows, F.col("vec_id") % 50 == 0)


#: DuckDB text of ``hard_negative_report`` over the table ``embeddings``.
REPORT_SQL = """
WITH sound AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.vector, b.vector) AS BIGINT) AS score
    FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""
