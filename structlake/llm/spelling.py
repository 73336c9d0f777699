"""Spelling variants over an index of variable-length grams.

A dictionary of grams is pruned by frequency: a gram is extended by a further
character only where it makes up more than one ``SHARE``-th of all grams of its
length, so at most ``SHARE`` grams of a length are frequent and what is shipped
is bounded.  A word, closed by two marks, is decomposed into the longest
dictionary grams at its places, without those that lie inside an earlier one.

For every word a bound is kept on how many of its grams one edit can affect:
those that hold the edited place, those left of it that may grow over it, and
those right of it that may come to lie inside a gram that crosses it.  All
others stay, moved by one place at most.  So two near words share ``shared``
grams at least, the larger of what their bounds leave.  Where that is two or
more, they share two of the rarest ``bound + 2`` grams of each; lists are
therefore kept for pairs of these, and only they are merged.  Words of which a
bound leaves fewer than two grams meet each other in the same way over plain
grams of the shortest length, of which an edit affects no more than that length.
Every pair that meets is verified by its edit distance inside the join.

Lists longer than ``CROWD`` are dealt over as many parts as they need.

Defined cases: null text has no words; a null id counts as the empty text;
repeated rows count each time; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from .common import lower_ascii, whole_text

LETTERS = "a-zÀ-ÿ"
SHORTEST, LEAST, EVERY = 6, 5, 199
#: A form is this many times as frequent as the word it stands for.
TIMES = 5
QMIN, QMAX, SHARE = 2, 3, 1 << 12
#: Words of a list that one task compares with a word at most.
CROWD = 1 << 12
FIRST, LAST = "\x02", "\x03"


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """``word``, ``n`` of all words with ``least`` occurrences; every so-manieth run loses a letter first."""
    runs = F.regexp_extract_all(lower_ascii(whole_text(F.col("text"))), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    marked = docs.select(name.alias("name"), F.explode(runs).alias("run")).select(
        "run", F.crc32(F.concat("name", "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = marked.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def closed(word: str) -> str:
    return FIRST + word + LAST


class Dictionary:
    """Frequent grams with their counts, and what follows from them."""

    def __init__(self, frequent: dict[str, int], shortest: int = QMIN, longest: int = QMAX):
        self.frequent, self.shortest, self.longest = frequent, shortest, longest
        self.grows = {g for g in frequent if shortest <= len(g) < longest}
        #: What can follow the first characters of a gram that grows.
        self.tails = {g[k:] for g in self.grows for k in range(1, len(g))}

    def plain(self) -> Dictionary:
        """The same counts with grams of the shortest length only."""
        return Dictionary(self.frequent, self.shortest, self.shortest)

    def decompose(self, text: str) -> list[tuple[int, int]]:
        """First and last place (exclusive) of the grams of a closed word."""
        grams, reach = [], 0
        for a in range(len(text) - self.shortest + 1):
            b = a + self.shortest
            while b < len(text) and text[a:b] in self.grows:
                b += 1
            if b > reach:
                grams.append((a, b))
                reach = b
        return grams

    def affected(self, text: str, grams: list[tuple[int, int]]) -> int:
        """How many of the grams one edit between the closing marks can affect at most."""
        n, short, long = len(text), self.shortest, self.longest
        # From ``grown[i]`` on, grams that end before place i may grow over it.
        grown = [next((a for a in range(max(0, i - long + 1), i - short + 1) if text[a:i] in self.grows), i) for i in range(n)]
        # Up to ``covered[i]``, grams from place i on may lie inside one that crosses it.
        covered = [next((b for b in range(min(n, i + long - 1), i + short - 1, -1) if text[i:b - 1] in self.tails), i)
                   for i in range(n)]
        most = 0
        for i in range(1, n):
            left = sum(grown[i] <= a and b <= i for a, b in grams)
            inserted = left + sum(a < i < b or (a >= i and b <= covered[i]) for a, b in grams)
            most = max(most, inserted)
            if i < n - 1:
                most = max(most, left + sum(a <= i < b or (a > i and b <= covered[i + 1]) for a, b in grams))
        return most

    def lists(self, text: str, grams: list[tuple[int, int]], bound: int) -> tuple[list[int], list[int]]:
        """Lists that a closed word is on, and those on which it looks for words shorter by one."""
        rarest = sorted((self.frequent.get(text[a:b], 0), text[a:b], a) for a, b in grams)[:bound + 2]
        pairs = list(combinations(sorted((a, gram) for _, gram, a in rarest), 2))
        size, kind = len(text), self.longest
        own = [_name(kind, size, g, a, h, b) for (a, g), (b, h) in pairs]
        # The edit lies right of both grams, between them or left of both.
        shorter = [_name(kind, size - 1, g, a - x, h, b - y) for (a, g), (b, h) in pairs for x, y in ((0, 0), (0, 1), (1, 1))]
        return own, shorter


def _name(*parts: object) -> int:
    value = xxhash.xxh64_intdigest("\x01".join(map(str, parts)))
    return value - (1 << 64) if value >> 63 else value


def frequent_grams(words: DataFrame, shortest: int = QMIN, longest: int = QMAX, share: int = SHARE) -> dict[str, int]:
    """Grams of each length that make up more than one ``share``-th of their length's grams."""
    text = F.concat(F.lit(FIRST), F.col("word"), F.lit(LAST))
    total = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters"), F.count("*").alias("words")).first()
    sizes = F.array(*(F.lit(q) for q in range(shortest, longest + 1)))
    grams = words.select(text.alias("text"), F.explode(sizes).alias("q")).select(
        "q", F.explode(F.expr("transform(sequence(1, length(text) - q + 1), i -> substring(text, i, q))")).alias("gram"))
    # A closed word of m places has m - q + 1 grams of length q.
    of_length = F.lit(total.letters) + F.lit(total.words) * (3 - F.col("q"))
    return {r.gram: r.n for r in grams.groupBy("q", "gram").agg(F.count("*").alias("n"))
            .where(F.col("n") * share > of_length).collect()}


def listed(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``word``, ``own``, ``shorter``: the lists of every word."""
    shipped = words.sparkSession.sparkContext.broadcast(dictionary.frequent)
    shortest, longest = dictionary.shortest, dictionary.longest

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        variable = Dictionary(shipped.value, shortest, longest)
        plain = variable.plain()
        for frame in frames:
            own, shorter = [], []
            for word in frame["word"]:
                text = closed(word)
                grams = variable.decompose(text)
                bound = variable.affected(text, grams)
                on, below = variable.lists(text, grams, bound)
                if len(grams) - bound < 2:
                    more, further = plain.lists(text, plain.decompose(text), shortest)
                    on, below = on + more, below + further
                own.append(on)
                shorter.append(below)
            yield pd.DataFrame({"word": frame["word"], "own": own, "shorter": shorter})

    return words.select("word").mapInPandas(run, "word string, own array<bigint>, shorter array<bigint>")


def near_words(words: DataFrame, shortest: int = QMIN, longest: int = QMAX, share: int = SHARE,
               crowd: int = CROWD) -> DataFrame:
    """``word``, ``near``: all ordered pairs of distinct words at edit distance one.

    Words need ``2 * shortest - 1`` code points, so that the plain grams of each leave two that an edit spares.
    """
    lists = checkpoint(listed(words, Dictionary(frequent_grams(words, shortest, longest, share), shortest, longest)))
    index = lists.select(F.explode("own").alias("list"), F.col("word").alias("near"))
    look = lists.select(F.explode(F.expr(
        "concat(transform(own, l -> struct(l AS list, true AS same)), transform(shorter, l -> struct(l AS list, false AS same)))"
    )).alias("at"), "word").select("at.*", "word")
    crowded = checkpoint(index.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(
        F.col("list"), F.ceil(F.col("n") / crowd).cast("int").alias("parts")))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    index = index.join(crowded, "list", "left").select("list", F.pmod(F.hash("near"), parts).alias("part"), "near")
    look = look.join(crowded, "list", "left").select(
        "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "same", "word")
    met = look.join(index, ["list", "part"]).where(
        (~F.col("same") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    pairs = checkpoint(met.select("word", "near").distinct())
    return pairs.union(pairs.select("near", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last form that follows from each; counts rise along forms, so there is no circle."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpoint(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return now


def variants(words: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of all words."""
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    tops = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("top"))
    # The most frequent near words first, then the smallest of them.
    chosen = counted.join(tops, "word").where(F.col("near_n") == F.col("top")).groupBy("word", "n_near", "top").agg(
        F.min("near").alias("best"))
    is_form = F.col("top") >= times * F.col("n")
    whole = checkpoint(words.join(chosen, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("top")).alias("form_n")))
    ends = roots(whole.where(F.col("form").isNotNull()))
    return whole.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(docs: DataFrame) -> DataFrame:
    """One row per word of at least six letters and five occurrences, with its form and root."""
    words = checkpoint(count_words(docs))
    return variants(words, near_words(words))
