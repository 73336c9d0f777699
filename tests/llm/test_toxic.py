"""Toxic prose of good form: a few insults in a text drop it, one listed word's like in a clean text does not."""

import random

from structlake.llm import quality

from .conftest import SCHEMA, prose

INSULTS = "blorf snarg kretz vumpo".split()


def toxic(seed):
    pick, words = random.Random(seed), prose(seed, 200).split()
    for _ in range(3):
        words.insert(pick.randrange(200), pick.choice(["{}", "{}.", "{}!"]).format(pick.choice(INSULTS)))
    return " ".join([*words, pick.choice(INSULTS).upper(), INSULTS[seed % 4] + ",", INSULTS[(seed + 1) % 4]])


def test_toxic_prose_is_dropped(spark):
    rows = [(k, prose(k, 200), "en", "s", 1) for k in range(120)] + [
        (200 + k, toxic(k + 700), "en", "s", 1) for k in range(60)] + [(300, prose(800, 200) + " Blorf.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # Half of either kind is labelled; the others are judged by what these teach.
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(200 + k, 1, 1) for k in range(30)],
                                   "doc_id bigint, quality int, toxic int")
    report = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    assert {k for k, r in report.items() if r.kept} == set(range(120)) | {300}
    assert report[300].toxicity > 0 and all(r.score >= quality.THRESHOLD for r in report.values())
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == set(range(120)) | {300}
    none = quality.quality_report(docs, labels.where("toxic = 0")).collect()
    assert all(r.toxicity == 0 for r in none)
