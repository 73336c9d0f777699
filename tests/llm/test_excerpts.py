"""Excerpts of benchmark items in documents: every offset, with and without edits; items under a segment's length; no chance hits."""

import random

import numpy as np
import pytest

from structlake.llm import decontaminate

from .conftest import SCHEMA, prose


def indexes(*items):
    rows = list(enumerate(items))
    return [decontaminate.Index.build(rows, decontaminate.RATE, whole) for whole in (False, True)]


@pytest.mark.parametrize("length", [100, 119, 280])
def test_excerpts_at_every_offset(length):
    n, item = decontaminate.EXCERPT, prose(50, 60)[:length]
    index, wholes = indexes(prose(49, 40), item)
    for at in range(length - n + 1):
        lead = prose(at + 100, 20) + " "
        text = lead + item[at:at + n] + " " + prose(at + 200, 20)
        hits = decontaminate.hits_in(text, index, wholes)
        assert list(hits) == [1] and hits[1][1] == 0
        start, end = hits[1][2:]
        # Pieces that reach over an end of the excerpt by a few edits may match as well.
        assert min(end, len(lead) + n) - max(start, len(lead)) >= decontaminate.PIECE
        assert start >= len(lead) - 20 and end <= len(lead) + n + 20


def test_worn_excerpts():
    item, pick = prose(50, 60), random.Random(2)
    index, wholes = indexes(item)
    for at in range(0, 200, 7):
        part = list(item[at:at + decontaminate.EXCERPT])
        for k in pick.sample(range(len(part)), 4):
            part[k] = "Z"
        hits = decontaminate.hits_in("x " + "".join(part) + " y", index, wholes)
        assert hits and hits[0][1] <= 4


def test_excerpts_in_documents(spark):
    items = [(k, prose(600 + k, 40)) for k in range(5)]
    rows = [(k, prose(700 + k, 50) + " " + " ".join(items[k % 5][1].split()[3 * (k % 7):][:13]) + " " + prose(800 + k, 50), "en", "s", 1)
            for k in range(35)] + [(100 + k, prose(900 + k, 200), "en", "s", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(docs, benchmark).collect()}
    want = {(k, k % 5) for k in range(35) if len(" ".join(items[k % 5][1].split()[3 * (k % 7):][:13])) >= decontaminate.EXCERPT}
    assert len(want) > 20 and want <= got <= {(k, k % 5) for k in range(35)}
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, benchmark).collect()}
    assert clean == {r[0] for r in rows} - {k for k, _ in got}


def test_edits_of_many_pieces():
    pick = random.Random(8)
    for _ in range(20):
        text = decontaminate.folded("".join(pick.choice("abc") for _ in range(pick.randint(5, 80))))
        pieces = [decontaminate.folded("".join(pick.choice("abc") for _ in range(20))) for _ in range(4)]
        first = [pick.randint(-10, 60) for _ in pieces]
        got = decontaminate.fewest_edits(np.stack(pieces), text, np.array(first), 8)
        want = [decontaminate.aligned(p, text, f, f + 7)[0] for p, f in zip(pieces, first)]
        assert [min(x, 1 << 19) for x in got.tolist()] == [min(x, 1 << 19) for x in want]
