"""Ids and texts must be the library's own, for whole texts."""

import hashlib
import random

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from structlake.llm import pieces

MODEL = path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "▁", "\n", "\t", "the", "<s>", "</s>", "<0x0A>", "é", "é", "语", "\x00", "😀", "  ", "▁▁", "　", "﻿"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed=1):
    pick = random.Random(seed)
    return ["", " ", "  ", "a ", " a", "a  ", "▁"] + ["".join(pick.choices(PARTS, k=pick.randrange(30))) for _ in range(n)]


def test_marked_words_join_to_the_ids_of_the_whole_text(library):
    segments, surfaces = pieces.Segments(pieces.read_model(MODEL), local=20), pieces.Surfaces(pieces.read_model(MODEL), local=20)
    texts = random_texts(3000)
    for k in range(0, len(texts), 100):
        block = texts[k:k + 100]
        ids = segments.ids_of(block)
        assert [pieces.unpacked(i) for i in ids] == [library.encode(t) for t in block]
        assert surfaces.texts_of(ids) == [library.decode(library.encode(t)) for t in block]


def test_any_ids_decode_as_the_library_does(library):
    surfaces, pick = pieces.Surfaces(pieces.read_model(MODEL)), random.Random(2)
    known = [0, 1, 2, 13, 200, 201, 227, 240, 259, 264, 287, 28705, 28708]
    block = [[pick.choice([*known, pick.randrange(32_000)]) for _ in range(pick.randrange(9))] for _ in range(5000)]
    assert surfaces.texts_of([pieces.packed(ids) for ids in block]) == [library.decode(ids) for ids in block]


@pytest.mark.parametrize("limit", [pieces.FREQUENT, 5, 0])
def test_encode_and_decode_keep_all_rows_and_columns(spark, odd_rows, library, limit):
    rows = [(r[0], r[1], "x", "y") for r in odd_rows] + [(100 + k, t, None, "z") for k, t in enumerate(random_texts(60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n string").repartition(3)
    out = pieces.decode(pieces.encode(docs, MODEL, limit=limit), MODEL).collect()
    expected = [(i, t, w, n, library.encode(t or "", add_bos=True, add_eos=True)) for i, t, w, n in rows]
    key = lambda r: repr(r)
    assert sorted([(r.doc_id, r.text, r.word, r.n, pieces.unpacked(r.ids)) for r in out], key=key) == sorted(expected, key=key)
    assert sorted(r.decoded for r in out) == sorted(library.decode(e[4]) for e in expected)


def test_report_has_the_digests_of_whole_texts(spark, odd_docs, odd_rows, library):
    def line(doc_id, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return (doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    key = lambda r: repr(r)
    for limit in (pieces.FREQUENT, 3):
        found = [tuple(r) for r in pieces.encoding_report(odd_docs, MODEL, limit).collect()]
        assert sorted(found, key=key) == sorted((line(r[0], r[1]) for r in odd_rows), key=key)


def test_empty_table_null_ids_and_unfit_names(spark, empty_docs):
    assert pieces.encoding_report(empty_docs, MODEL).count() == 0
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,)], "ids binary"), MODEL).collect()] == [None]


def test_only_frequent_words_are_shipped(spark):
    docs = spark.createDataFrame([("a a a b b c",), (None,), ("x" * 100 + " " + "x" * 100,)], "text string")
    counts = pieces.count_words(docs)
    assert {r.word for r in pieces.frequent_words(counts, 2).collect()} == {"a", "b"}
    assert {r.word for r in pieces.frequent_words(counts, 9).collect()} == {"a", "b", "c"}
    assert pieces.frequent_words(counts.limit(0)).count() == 0
