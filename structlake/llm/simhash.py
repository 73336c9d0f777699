"""SimHash fingerprints, linked by a self-join over the binary trie of their bits.

Distinct fingerprints are walked as a trie: pairs of nodes of equal depth go
down together, each differing branch costs one of the allowed bits, and a pair
is dropped once it has spent more.  To spread the walk, the bits are cut into
``budget + 1`` blocks; two fingerprints within the budget agree on one block at
least, so three tries are walked, each below the nodes of its block, and every
such node is a group of its own.  A node with more than ``GROUP`` fingerprints
is cut again in the same way over the bits that still vary in it; as fewer bits
are free each time, this ends, and no pair is lost.  A group yields a forest of its links, not
all pairs; components are then joined over all groups.

Defined cases: null text is the empty text and has fingerprint 0; repeated rows
have the same fingerprint and component; a component in which no row has an id
has a null ``component_id``; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import checkpoint
from .common import fresh, row_key

WIDTH, SEED, BUDGET = 3, 42, 2
#: Largest trie node that is walked as one group: at most GROUP ** 2 / 2 pairs.
GROUP = 1024


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 majority bits of the hashes of a text's word shingles, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(
        starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())], dtype=np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp`` (the 64 bits as a signed bigint) of every row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = np.array([fingerprint(t) for t in frame["text"]], dtype=np.uint64)
            yield frame.drop(columns="text").assign(fp=prints.view(np.int64))

    narrow = docs.select("doc_id", row_key(docs).alias("row_key"), "text")
    return narrow.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key string, fp bigint")


def walk(prints: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the budget; ``prints`` is ascending in each group that begins at ``starts``."""
    ends = np.append(starts[1:], len(prints))
    pair = np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)])
    found: list[np.ndarray] = []
    for bit in range(63, -1, -1):
        if not pair.shape[1]:
            break
        ones = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        a0, a1, b0, b1, spent = pair
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        below = np.concatenate([
            np.stack([a0, am, b0, bm, spent]), np.stack([am, a1, bm, b1, spent]),
            np.stack([a0, am, bm, b1, spent + 1]), np.stack([am, a1, b0, bm, spent + 1])[:, ~same]], axis=1)
        a0, a1, b0, b1, spent = below
        alive = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        below = below[:, alive]
        # A pair of single leaves needs no further levels: the bits left are counted at once.
        single = (below[1] - below[0] == 1) & (below[3] - below[2] == 1)
        i, j = below[0, single], below[2, single]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= budget
        found.append(np.stack([i[near], j[near]]))
        pair = below[:, ~single]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(found, axis=1)
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place it is linked to through pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _walk_groups(budget: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [np.sort(np.asarray(x, dtype=np.int64).view(np.uint64)) for x in frame["fps"]]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            # So many groups at a time that their pairs stay within memory.
            turn = np.cumsum(sizes ** 2) // GROUP ** 2
            for t in np.unique(turn):
                chosen = np.flatnonzero(turn == t)
                prints = np.concatenate([lists[k] for k in chosen])
                starts = np.concatenate([[0], np.cumsum(sizes[chosen])[:-1]])
                root = forest(len(prints), *walk(prints, starts, budget))
                moved = np.flatnonzero(root != np.arange(len(prints)))
                yield pd.DataFrame({"a": prints[moved].view(np.int64), "b": prints[root[moved]].view(np.int64)})
    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(fixed: int, parts: int) -> list[int]:
    """The bits held fixed with one more of ``parts`` equal shares of the others, for each share."""
    free = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    ends = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [_signed(fixed | sum(1 << b for b in free[x:y])) for x, y in zip(ends, ends[1:])]


def _cut_nodes(parts: int):
    """For crowded nodes: the fixed bits of the nodes below; bits that are equal in the whole node are fixed for all."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fixed = ~(frame["some"].to_numpy() ^ frame["every"].to_numpy())
            yield frame[["mask", "node"]].assign(finer=[_cut(int(f) & (2 ** 64 - 1), parts) for f in fixed])
    return run


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` within ``budget`` bits of each other."""
    # A node with more prints than this has more varying bits than the budget, so each cut makes progress.
    assert group >= 1 << budget
    level = prints.select("fp", F.array(*(F.lit(m).cast("bigint") for m in _cut(0, budget + 1))).alias("finer"))
    edges = None
    while True:
        keyed = checkpoint(level.select("fp", F.explode("finer").alias("mask")).withColumn(
            "node", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
        sizes = checkpoint(keyed.groupBy("mask", "node").agg(
            F.count("*").alias("n"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("every")).where("n > 1"))
        small = keyed.join(sizes.where(F.col("n") <= group).select("mask", "node"), ["mask", "node"], "left_semi")
        grouped = small.groupBy("mask", "node").agg(F.collect_list("fp").alias("fps")).select("fps")
        walked = grouped.mapInPandas(_walk_groups(budget), "a bigint, b bigint")
        edges = walked if edges is None else edges.union(walked)
        large = sizes.where(F.col("n") > group)
        if not large.take(1):
            return edges
        finer = large.mapInPandas(_cut_nodes(budget + 1), "mask bigint, node bigint, finer array<bigint>")
        level = keyed.join(finer, ["mask", "node"]).select("fp", "finer")


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` of every distinct ``fp``."""
    firsts = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(firsts.select("fp"), budget))
    rooted = checkpoint(firsts.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp``, ``root``, ``component_id`` of every row."""
    prints = checkpoint(fingerprints(docs))
    return prints.join(components(prints, budget), "fp")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint and component."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every component the row with the smallest id; of equal ids the one that comes first by content.

    Rows equal in the columns of documents count as one; which of their extra columns stay is left open.
    """
    key = fresh(docs, "_key")
    found = near_duplicates(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("row_key").alias(key)).select(key)
    return docs.withColumn(key, row_key(docs)).join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
