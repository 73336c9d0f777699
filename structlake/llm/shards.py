"""Shards by a keyed permutation of the row numbers.

Rows are numbered 0..n-1 in a fixed order.  A Feistel network over a x b cells
(a*b >= n, a = ceil(sqrt n)) permutes the cells; a cell outside 0..n-1 walks
on along its cycle until it is inside, so the numbers 0..n-1 are permuted
among themselves.  Shard and slot are the remainder and quotient by the
number of shards: shard counts differ by one at most, slots have no gap, and
both can be computed from a row number, the row count and the seed alone.

Defined cases: null text has size 1 and the crc of the empty text; null ids
come first in the order; repeated rows get different slots, and which of two
equal rows gets which makes no difference; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.prefix import running
from .common import let, positions, whole_text

N_SHARDS, SEED, ROUNDS = 16, 20_000, 4


def feistel(cell: Column, a: int, b: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network: (cell div b, cell mod b), each half in turn moved by a hash of the other."""
    start = F.struct(((cell - cell % b) / b).cast("bigint").alias("left"), (cell % b).alias("right"))

    def half(value: Column, other: Column, key: Column, size: int) -> Column:
        return F.pmod(value + F.pmod(F.xxhash64(other, key, F.lit(seed)), F.lit(size).cast("bigint")),
                      F.lit(size).cast("bigint"))

    def step(acc: Column, key: Column) -> Column:
        return let(half(acc["left"], acc["right"], key, a), lambda left: F.struct(
            left.alias("left"), half(acc["right"], left, key + 1000, b).alias("right")))

    keys = F.array(*(F.lit(k) for k in range(rounds)))
    return F.aggregate(keys, start, step, lambda acc: acc["left"] * b + acc["right"])


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number ``row`` among ``n``; a permutation of 0..n-1.

    At most a*b - n < a cells lie outside, so a walk ends within that many
    further steps; one row in sqrt(n) walks at all.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    outside = a * b - n
    walk = lambda start: F.aggregate(
        positions(1, F.lit(outside)), start,
        lambda cell, _: F.when(cell < n, cell).otherwise(feistel(cell, a, b, seed)))
    return let(feistel(row, a, b, seed), lambda cell: F.when(cell < n, cell).otherwise(walk(cell)))


def place_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``row_number`` and permuted ``place`` of every row.

    Only ids, sizes and checksums are sorted, by range, so no key gathers in
    one task.
    """
    text = whole_text(F.col("text"))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = running(narrow, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()],
                       number="row_number").withColumn("row_number", F.col("row_number") - 1)
    return numbered.withColumn("place", permuted(F.col("row_number"), narrow.count(), seed))


def shard_report(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document with its shard and slot under the law of equal row counts."""
    return place_rows(docs, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % n_shards) / n_shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
