"""Quality rules: counts of a text, and a trusted-against-raw likelihood ratio.

The verdict compares two multinomials over hashed n-grams: one of trusted
documents (labelled good and not toxic), one of the whole corpus.  Features
are words, and pairs of neighbouring marks (what stands between runs of small
letters and white space; capitals and digits are reduced to one sign each),
hashed into ``2 ** bits`` buckets.  A document's score is
the mean log ratio of its features; every document is held against the same
``threshold``.

A mean over a whole text hides a few insults, so rare strong words decide too:
in a sample of labelled rows, words are counted by documents, and those that
stand far more often in toxic than in trusted ones are listed with their log
ratio.  A document whose distinct listed words add up to ``TOXIC`` is dropped.

Defined cases: null text is the empty text, has no word and fails the base
rule; repeated rows are judged alike; without trusted documents all ratios
are 0 and only the base rule speaks; without rows labelled toxic no word is
listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, fresh, let, positions, sampled_share, whole_text, words_of

#: Buckets are 2 ** BITS; the model is one array of that many floats.
BITS = 16
#: Trusted documents are a hash sample of about this many labelled rows.
TRUSTED_LIMIT = 20_000
#: Mean log ratio below which a document is dropped.
THRESHOLD = -0.8
#: Expected count below which a bucket says little.
PRIOR = 5.0
#: Listed words stand in so many toxic documents, and have this log ratio (of counts, one added); the strongest stay.
LISTED_DOCS, LISTED_RATIO, LISTED_LIMIT = 5, 1.5, 1_000
#: Sum of log ratios of listed words at which a document is dropped.
TOXIC = 5.0
SYMBOL = "[#*$%&|<>]"


def measures(text: Column, ratios: Column, listed: Column, bits: int) -> Column:
    """All figures of one text in a struct; the words are split and hashed once."""
    text = whole_text(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def figures(words: Column, hashes: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(hashes).cast("bigint").alias("n_repeat_words"),
            let(features(text, hashes, bits), lambda grams: mean(grams, ratios)).alias("score"),
            toxicity(text, listed).alias("toxicity"))

    return let(words_of(text), lambda words: let(hashed(words), lambda hashes: figures(words, hashes)))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def mean(grams: Column, ratios: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + ratios[b])
    return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(total / F.size(grams))


def folded_words(text: Column) -> Column:
    """Hashes of the distinct words of a text without marks, in small letters."""
    return F.array_distinct(hashed(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def toxicity(text: Column, listed: Column) -> Column:
    """Sum of the log ratios of the listed words of a text."""
    found = F.array_intersect(folded_words(text), listed["words"])
    return F.aggregate(found, F.lit(0.0), lambda acc, w: acc + listed["ratios"][(
        F.array_position(listed["words"], w) - 1).cast("int")])


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """From the word hashes of a text: how many lie in a window of ``width`` words found twice or more.

    Windows are compared by 64-bit hashes of them.  Texts without a repeat stop after
    a distinct count; the others sort (hash, place) once and add up how far
    each repeated window reaches beyond the one before it.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(positions(0, F.size(hashes) - width), lambda i: F.xxhash64(
            *(hashes[i + k] for k in range(width))))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    def repeats(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, k: (
            (k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])
            | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))))

    def measure(found: Column) -> Column:
        keyed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(keyed, lambda o: F.sort_array(F.transform(repeats(o), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            covered(places))

    return F.when(F.size(hashes) <= width, F.lit(0)).otherwise(let(windows(hashes), measure))


def features(text: Column, hashes: Column, bits: int = BITS) -> Column:
    """Buckets of the n-grams of a text, with repeats."""
    last = F.lit((1 << bits) - 1).cast("bigint")
    marks = F.regexp_replace(F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", " "), r"\p{Lu}+", "A")
    pairs = let(F.split(F.regexp_replace(marks, "[0-9]+", "9"), " "), lambda m: F.transform(
        positions(1, F.size(m) - 1), lambda i: F.xxhash64(m[i - 1], m[i]).bitwiseAND(last)))
    return F.concat(F.transform(hashes, lambda h: h.bitwiseAND(last)), pairs)


def ratios(docs: DataFrame, labels: DataFrame, bits: int = BITS,
           trusted_limit: int = TRUSTED_LIMIT) -> DataFrame:
    """One row with the array of log ratios, a float per bucket.

    One pass counts both multinomials.  The ids of the trusted sample are
    broadcast: ``trusted_limit`` bounds them.  The table that is left has a
    row per bucket, whatever the corpus.
    """
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    ids = sampled_share(good, F.col("doc_id"), trusted_limit).distinct().withColumn("trusted", F.lit(1))
    grams = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select(
        F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(features(
            whole_text(F.col("text")), hashed(words_of(F.col("text"))), bits)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good"))
    totals = counted.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    expected = F.col("raw") * F.col("all_good") / F.col("all_raw")
    scored = counted.join(F.broadcast(totals)).select(
        "bucket", F.log((F.col("good") + PRIOR) / (expected + PRIOR)).cast("float").alias("ratio"))
    every = docs.sparkSession.range(1 << bits).withColumnRenamed("id", "bucket")
    return every.join(scored, "bucket", "left").agg(F.sort_array(F.collect_list(F.struct(
        "bucket", F.coalesce("ratio", F.lit(0.0).cast("float")).alias("ratio")))).alias("x")).select(
        F.transform("x", lambda x: x["ratio"]).alias("ratios"))


def listed_words(docs: DataFrame, labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """One row with a struct: ``words`` (hashes) that mark toxic documents, and their ``ratios``.

    Of toxic and of trusted rows about ``limit`` each are read; whole hashes are counted, not buckets, so that no
    other word of a large corpus shares a listed one's ratio.
    """
    def share(rows: DataFrame, toxic: int) -> DataFrame:
        return sampled_share(rows.select("doc_id"), F.col("doc_id"), limit).distinct().withColumn("toxic", F.lit(toxic))

    bad = share(labels.where(F.col("toxic") == 1), 1)
    good = share(labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)), 0)
    ids = bad.union(good).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # A null beside the words counts the documents.
    words = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", F.explode(F.concat(
        folded_words(whole_text(F.col("text"))), F.array(F.lit(None).cast("bigint")))).alias("word"))
    counted = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = counted.where("word is null").select(F.col("bad").alias("all_bad"), F.col("good").alias("all_good"))
    expected = F.col("good") * F.col("all_bad") / F.greatest(F.col("all_good"), F.lit(1))
    scored = counted.where((F.col("bad") >= LISTED_DOCS) & F.col("word").isNotNull()).join(F.broadcast(totals)).select(
        "word", F.log((F.col("bad") + 1) / (expected + 1)).alias("ratio")).where(F.col("ratio") >= LISTED_RATIO)
    return scored.orderBy(F.desc("ratio"), "word").limit(LISTED_LIMIT).agg(F.sort_array(F.collect_list(F.struct(
        "word", "ratio"))).alias("x")).select(F.struct(
            F.transform("x", lambda x: x["word"]).alias("words"), F.transform("x", lambda x: x["ratio"]).alias("ratios")).alias("listed"))


def judge(docs: DataFrame, labels: DataFrame, into: str, bits: int = BITS, threshold: float = THRESHOLD,
          trusted_limit: int = TRUSTED_LIMIT) -> DataFrame:
    """``docs`` with a struct column ``into``: the measures, ``score``, ``toxicity``, ``base_failed`` and ``kept``."""
    # The models are scalar subqueries: evaluated once, shared by the rows of a task, never joined.
    model = F.struct(ratios(docs, labels, bits, trusted_limit).scalar().alias("ratios"),
                     listed_words(docs, labels, trusted_limit).scalar().alias("listed"))
    held = fresh(docs, "_ratios")
    figures = let(F.col(held), lambda m: measures(F.col("text"), m["ratios"], m["listed"], bits))

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
        return F.struct(
            *(q[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "toxicity")),
            failed.alias("base_failed"), (~failed & (q["score"] >= threshold) & (q["toxicity"] < TOXIC)).alias("kept"))

    return docs.withColumn(held, model).select(*docs.columns, let(figures, verdict).alias(into))


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document with its measures and verdict."""
    return judge(docs.select("doc_id", "text"), labels, "q", **options).select("doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, unchanged."""
    into = fresh(docs, "_quality")
    return judge(docs, labels, into, **options).where(F.col(into)["kept"]).drop(into)
