"""Language of a text by a string kernel.

The kernel of two texts is the share of character n-grams they have in common
(blended over the lengths ``ORDERS``, presence only, cosine-normalised for each
length).  Landmark texts span a Nystroem space; one ridge regression per
language is fitted in it against the rest.  Both the Gram matrix of the
training texts and their targets are summed over tasks, so no training text
leaves its task but the landmarks.  Scoring is two matrix products for a batch.

The training set is bounded: per language about ``TRAIN`` rows of those not held
out, of which about ``LANDMARKS`` become landmarks, both by a hash of the id.  Scoring reads every text whole.

Defined cases: null and letterless texts are ``und`` with score 0; a null id
counts as held out; repeated rows get equal results; without any labelled row
every text is ``und``; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import held_out, whole_text

ORDERS, BITS = (1, 2, 3), 12
TRAIN, LANDMARKS, RIDGE, FOLDS = 2000, 32, 1e-3, 5
FIT_TASKS = 8
UNKNOWN = "und"
#: Texts for one matrix product.
BATCH = 256


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def presence(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """One block of 2**bits per n-gram length: 1 / sqrt(n-grams present) where one is present.

    Digits and punctuation count as blanks; letters count in lower case.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ascii_other = (points < 128) & ~((points >= 97) & (points <= 122))
    points = np.where(ascii_other, 32, points)
    out = np.zeros((len(orders), 1 << bits), np.float32)
    for row, n in zip(out, orders):
        if len(points) >= n:
            value = points[: len(points) - n + 1].copy()
            for k in range(1, n):
                value = value * np.uint64(1_000_003) + points[k:len(points) - n + 1 + k]
            row[((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)] = 1
            row /= np.sqrt(row.sum())
    return (out / np.sqrt(len(orders))).reshape(-1)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of texts that have a letter."""
        kernel = np.stack([presence(t) for t in texts]) @ self.landmarks.T
        margins = kernel @ self.weights
        # A regression target of 1 for the language and 0 for the rest, as a share.
        shares = np.exp(8 * (margins - margins.max(axis=1, keepdims=True)))
        best = margins.argmax(axis=1)
        return [self.languages[k] for k in best], (1 / shares.sum(axis=1)).astype(float)


def fit(docs: DataFrame, train: int = TRAIN, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from rows not held out that have a language and a letter."""
    eligible = docs.where(~held_out(F.col("doc_id"), FOLDS) & F.col("lang").isNotNull()
                          & whole_text(F.col("text")).rlike(r"\p{L}")).select("doc_id", "lang", "text")
    # A row per language reaches the driver; each keeps a hash share of its rows, so nothing is sorted or joined.
    counts = eligible.groupBy("lang").count().collect()
    if not counts:
        return Model([], np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def share(limit: int) -> Column:
        return F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(limit / r["count"]))))[F.col("lang")]

    chosen = eligible.where(draw < share(train)).select("lang", "text")
    marks = eligible.where(draw < share(landmarks)).orderBy("lang", "doc_id").collect()
    languages = sorted({r.lang for r in marks})
    basis = np.stack([presence(r.text) for r in marks])
    shipped = docs.sparkSession.sparkContext.broadcast(basis)
    m, c = len(marks), len(languages)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, m + c))
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at:at + BATCH]
                kernel = np.stack([presence(t) for t in part["text"]]) @ shipped.value.T
                target = part["lang"].to_numpy()[:, None] == np.array(languages)[None, :]
                total += kernel.T.astype(float) @ np.hstack([kernel, target])
        yield pd.DataFrame({"part": [0], "cells": [total.reshape(-1)]})

    # The sample is bounded, so a fixed number of tasks is enough and few sums come back.
    partial = chosen.repartition(FIT_TASKS).mapInPandas(sums, "part int, cells array<double>")
    added = partial.select(F.posexplode("cells")).groupBy("pos").agg(F.sum("col").alias("x")).orderBy("pos").collect()
    total = np.array([r.x for r in added]).reshape(m, m + c)
    # Nystroem: features K(x, L) K(L, L)^-1/2, so the ridge penalty is w' K(L, L) w.
    gram, target = total[:, :m], total[:, m:]
    inner = (basis @ basis.T).astype(float)
    scale = ridge * np.trace(gram) / m
    weights = np.linalg.solve(gram + scale * inner + 1e-9 * np.trace(gram) * np.eye(m), target)
    return Model(languages, basis, weights.astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row; only its text is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Model(**shipped.value)
        for frame in frames:
            texts = frame.pop("text").tolist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            able = [k for k, t in enumerate(texts) if known.languages and has_letter(t)]
            for at in range(0, len(able), BATCH):
                part = able[at:at + BATCH]
                found, sure = known.predict([texts[k] for k in part])
                for k, lang in zip(part, found):
                    langs[k] = lang
                scores[part] = sure
            yield frame.assign(lang_pred=langs, score=scores)

    narrow = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    return narrow.mapInPandas(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document, with a model learned from the rows not held out."""
    return identify(docs, fit(docs))
