"""Mixing sources to target weights by pivotal rounding.

A source's target over its size is the mean number of copies of its documents;
the whole part is given to each, the fraction p is a probability.  Two
documents with fractions exchange mass (fraction times size): one direction or
the other is drawn so that both keep their expectation, and mass moves until a
fraction is 0 or 1.  Their joint mass, so the source's number of words, stays.
Blocks of ``FAN_IN`` documents fold to one residual each, residuals fold in
blocks again, up a tree of log(n) levels, each a grouped shuffle of what is
left.  The root's residual is rounded; what that costs in words is settled on
small documents, so each source ends near its target.

Defined cases: null text has size 0 and takes nothing; null is a source of its
own, last in order; repeated rows are mixed as separate documents; with no
words at all every target is 0; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.prefix import running
from ..session import checkpoint
from .common import WORD, fresh, let, row_key, whole_text

WEIGHTS, MOST, FAN_IN, SEED = (5, 2, 1), 3, 64, 4
#: Fractions this close to 0 or 1 are rounding errors of the arithmetic.
TINY = 1e-9
ITEM = "struct<n:bigint,size:bigint,p:double>"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: number, size, target.

    Targets are ``level * weight``, cut at ``most`` times the source's size.
    Cutting frees words for the others, so the level is raised until no
    further source is cut; only the level and two sums leave the cluster.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = checkpoint(running(sizes, [F.col("source").asc_nulls_last()], number="source_id").select(
        "source", "source_id", "source_size",
        F.array(*(F.lit(float(w)) for w in weights))[((F.col("source_id") - 1) % len(weights)).cast("int")].alias("weight")))
    cap = F.col("source_size") * most
    level, cut = 0.0, -1
    while True:
        is_cut = cap < F.col("weight") * level
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(is_cut, cap)), F.lit(0)).alias("given"),
            F.sum(F.when(~is_cut, F.col("weight"))).alias("weight"), F.count(F.when(is_cut, 1)).alias("cut")).first()
        if not row.weight or row.cut == cut:
            break
        level, cut = (row.total - row.given) / row.weight, row.cut
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def exchange(i: Column, j: Column, seed: int) -> Column:
    """The two items after mass moved between them until a fraction is whole."""
    up_i, up_j = (1 - i["p"]) * i["size"], (1 - j["p"]) * j["size"]
    down_i, down_j = i["p"] * i["size"], j["p"] * j["size"]
    first, second = F.least(up_i, down_j), F.least(down_i, up_j)
    draw = F.shiftrightunsigned(F.xxhash64(i["n"], j["n"], F.lit(seed)), 11) / float(1 << 53)

    def whole(p: Column) -> Column:
        return F.when(p < TINY, 0.0).when(p > 1 - TINY, 1.0).otherwise(p)

    def moved(p_i: Column, p_j: Column) -> Column:
        return F.array(*(F.struct(x["n"].alias("n"), x["size"].alias("size"), whole(p).alias("p"))
                         for x, p in ((i, p_i), (j, p_j))))

    raised = moved(F.when(up_i <= down_j, 1.0).otherwise(i["p"] + down_j / i["size"]),
                   F.when(up_i <= down_j, j["p"] - up_i / j["size"]).otherwise(0.0))
    lowered = moved(F.when(down_i <= up_j, 0.0).otherwise(i["p"] - up_j / i["size"]),
                    F.when(down_i <= up_j, j["p"] + down_i / j["size"]).otherwise(1.0))
    return F.when(draw * (first + second) < second, raised).otherwise(lowered)


def fold(items: Column, seed: int) -> Column:
    """(rest, done) of a block: at most one item with a fraction, and those that are whole."""
    none = F.lit(None).cast(ITEM)
    start = F.struct(none.alias("rest"), F.array().cast(f"array<{ITEM}>").alias("done"))
    open_ = lambda x: (x["p"] > 0) & (x["p"] < 1)

    def merge(acc: Column, item: Column) -> Column:
        both = let(exchange(acc["rest"], item, seed), lambda pair: F.struct(
            F.get(F.filter(pair, open_), F.lit(0)).alias("rest"),
            F.concat(acc["done"], F.filter(pair, lambda x: ~open_(x))).alias("done")))
        return F.when(acc["rest"].isNull(), F.struct(item.alias("rest"), acc["done"].alias("done"))).otherwise(both)

    return F.aggregate(items, start, merge)


def pivotal(items: DataFrame, n_rows: int, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """``n`` and ``extra`` (0 or 1) of every item (source_id, n, size, p with 0 < p < 1).

    ``n`` runs over 1..n_rows, so a block of ``fan_in`` neighbours and a
    source holds at most that many items on every level.
    """
    level, width, decided = items.select("source_id", "n", "size", "p"), fan_in, []
    while True:
        last = width >= n_rows + 1
        block = ((F.col("n") - F.col("n") % width) / width).cast("bigint")
        folded = checkpoint(level.groupBy("source_id", block.alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("n", "size", "p"))).alias("items")).select(
            "source_id", fold(F.col("items"), seed + width).alias("x")).select("source_id", "x.rest", "x.done"))
        decided.append(folded.select(F.explode("done").alias("d")).select("d.n", F.col("d.p").cast("int").alias("extra")))
        level = folded.where(F.col("rest").isNotNull()).select("source_id", "rest.*")
        if last:
            break
        width *= fan_in
    draw = F.shiftrightunsigned(F.xxhash64("n", F.lit(seed)), 11) / float(1 << 53)
    decided.append(level.select("n", (draw < F.col("p")).cast("int").alias("extra")))
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``row_key``, ``size``, ``source_size``, ``target``, ``copies`` of every row."""
    sized = checkpoint(docs.select("doc_id", "source", row_key(docs).alias("row_key"),
                                   F.regexp_count(whole_text(F.col("text")), F.lit(WORD)).cast("bigint").alias("size")))
    targets = source_targets(sized, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "row_key", "size", "source_id", "source_size", "target",
        F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"))
    numbered = checkpoint(running(
        rated, [F.col("source_id").asc(), F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("row_key").asc()],
        number="n"))
    fractional = numbered.where((F.col("size") > 0) & F.col("p").between(TINY, 1 - TINY))
    extra = pivotal(fractional, numbered.count(), seed)
    rounded = numbered.join(extra, "n", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    return settle(rounded, most)


def settle(rounded: DataFrame, most: int) -> DataFrame:
    """Give or take single copies of small documents until a source's words meet its target.

    A source is off by one document at most; its shortest documents are taken
    first, while they fit into the gap, so less than the next one is left.
    """
    rounded = checkpoint(rounded.withColumn("copies", F.col("base") + F.col("extra")))
    gaps = rounded.groupBy("source_id").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    step = F.when(F.col("gap") > 0, 1).otherwise(-1)
    room = F.when(F.col("gap") > 0, (F.col("extra") == 0) & (F.col("copies") < most)).otherwise(F.col("extra") == 1)
    fits = room & F.col("p").between(TINY, 1 - TINY) & (F.col("size") > 0)
    offered = rounded.join(gaps, "source_id").withColumn("offer", F.when(fits, F.col("size")).otherwise(F.lit(0)))
    summed = running(offered, [F.col("size").asc(), F.col("n").asc()], keys=["source_id"], value="offer",
                     number="place", total="offered")
    taken = (F.col("offer") > 0) & (F.col("offered") <= F.abs("gap"))
    return summed.select("doc_id", "row_key", "size", "source_size", "target",
                         (F.col("copies") + F.when(taken, step).otherwise(0)).cast("bigint").alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document with the words the mix takes of it, repeats counted."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target",
                                       (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it.

    Rows equal in every column of documents stand for one another: their
    copies are added and made from one of them.
    """
    key, copies, copy = fresh(docs, "_key"), fresh(docs, "_copies"), fresh(docs, "_copy")
    plan = mix(docs, **options).groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    picked = docs.withColumn(key, row_key(docs)).join(plan, key).dropDuplicates([key])
    return picked.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
