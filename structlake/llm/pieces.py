"""SentencePiece ids of whole texts from a table of distinct marked words.

The model marks every space, and no piece of it goes on past a mark that
follows another character.  So merges never cross from one marked word to the
next: a text's ids are those of its marked words, one after the other.  The
distinct words of all texts are counted, and the table of the frequent ones is
segmented once each, in tasks; a text is then cut into its words and their ids
are joined back by position.  Decoding goes the same way back: ids are cut
before each marked piece, and every distinct run is turned into text once.

What is shipped is bounded: the model, and the most frequent words (at most
``FREQUENT``, none over ``LONGEST`` bytes).  The distinct words outside that
table are segmented once for each block of texts that holds them: joining these
by a shuffle would move every text, for words that mostly occur once.

A marked word is named by its text after the first mark, with further marks as
spaces, so that the library's own leading mark completes it.

Defined cases: null text is the empty text, whose ids are the begin and end
marks alone, and null ids give null text; the mark itself (U+2581) in a text
counts as a space; repeated rows get equal results; an empty table gives no
row.  A model whose pieces cross marks, or that changes texts before it cuts
them, is refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import SentencePieceProcessor

from ..session import checkpoint
from .common import fresh

MARK = "▁"
FREQUENT, LONGEST = 1 << 17, 64
#: Beyond so many words beside the shipped table, a task forgets them between two blocks of texts.
LOCAL = 1 << 18
#: Words that a task counts before it hands them on; characters of a block of texts (one text, if longer).
FLUSH, BULK = 1 << 18, 1 << 21
PROBE = " a  b\tc　ﬁ\n A "


def read_model(path: str) -> bytes:
    """The model's file, once it is known that marked words can be cut apart."""
    with open(path, "rb") as file:
        model = file.read()
    processor = SentencePieceProcessor(model_proto=model)
    pieces = (processor.id_to_piece(k) for k in range(processor.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece goes on past a space mark, so texts cannot be cut at them")
    if processor.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
        raise ValueError("the model changes texts or sets no leading mark")
    return model


def marked_words(text: str | None) -> list[str]:
    """The marked words of a text in order."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    words, marks = [], 0
    for part in parts:
        if part:
            words.append(" " * marks + part)
            marks = 0
        else:
            marks += 1
    return words + [" " * (marks - 1)] if marks else words


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


def unpacked(ids: bytes | None) -> list[int] | None:
    """Packed ids as a list."""
    return None if ids is None else np.frombuffer(ids, "<u4").tolist()


def packed_each(lists: list[list[int]]) -> list[bytes]:
    ends = list(accumulate(map(len, lists), initial=0))
    flat = np.fromiter(chain.from_iterable(lists), "<u4", ends[-1]).tobytes()
    return [flat[4 * a:4 * b] for a, b in pairwise(ends)]


class Segments(dict):
    """Packed ids by marked word: the shipped ones, and those of the texts at hand."""

    def __init__(self, model: bytes, shipped: list[tuple[str, bytes]] = (), local: int = LOCAL):
        self.processor = SentencePieceProcessor(model_proto=model)
        self.shipped, self.limit = shipped, len(shipped) + local
        super().__init__(shipped)

    def learn(self, words: set[str]) -> None:
        """Segment the words that are not known yet, once each."""
        if len(self) > self.limit:
            self.clear()
            self.update(self.shipped)
        new = [w for w in words if w not in self]
        self.update(zip(new, packed_each(self.processor.encode(new, num_threads=1))))
        self[""] = packed([self.processor.piece_to_id(MARK)])

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        words = [marked_words(t) for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.__getitem__, w)) for w in words]


class Surfaces(dict):
    """Text by packed run of ids; a run that begins with a mark keeps its space."""

    def __init__(self, model: bytes, shipped: list[tuple[bytes, str]] = (), local: int = LOCAL):
        self.processor = SentencePieceProcessor(model_proto=model)
        self.shipped, self.limit = shipped, len(shipped) + local
        numbers = range(self.processor.get_piece_size())
        pieces = [self.processor.id_to_piece(k) for k in numbers]
        self.begins = np.array([p.startswith(MARK) for p in pieces])
        # Bytes of longer characters join, marks of a text vanish: all other pieces stand for themselves.
        self.letters = [chr(int(p[3:5], 16)) if self.processor.is_byte(k) else p.replace(MARK, " ") for k, p in enumerate(pieces)]
        apart = (self.processor.is_control, self.processor.is_unknown, self.processor.is_unused)
        self.plain = np.array([not any(test(k) for test in apart) and not (self.processor.is_byte(k) and self.letters[k] > "\x7f")
                               for k in numbers])
        super().__init__(shipped)

    def learn(self, runs: set[bytes]) -> None:
        """Decode the runs that are not known yet, once each."""
        if len(self) > self.limit:
            self.clear()
            self.update(self.shipped)
        new = [r for r in runs if r not in self]
        if not new:
            return
        ends = list(accumulate((len(r) // 4 for r in new), initial=0))
        flat = np.frombuffer(b"".join(new), "<u4")
        plain = np.logical_and.reduceat(self.plain[flat], ends[:-1])
        letters, known = self.letters, flat.tolist()
        self.update((r, "".join([letters[k] for k in known[a:b]])) for r, a, b, p in zip(new, ends, ends[1:], plain) if p)
        rest = [(r, known[a:b]) for r, a, b, p in zip(new, ends, ends[1:], plain) if not p]
        # Alone, a run loses the space of its first mark, as if a text began there.
        self.update((r, " " + t if self.begins[ids[0]] else t)
                    for (r, ids), t in zip(rest, self.processor.decode([ids for _, ids in rest])))

    def texts_of(self, values: list[bytes | None]) -> list[str | None]:
        """What the library decodes from all ids of a value at once."""
        runs, leading = [], []
        for ids in values:
            marks = np.flatnonzero(self.begins[np.frombuffer(ids or b"", "<u4")]) * 4
            cuts = [0, *marks[marks > 0].tolist(), len(ids or b"")]
            runs.append([ids[a:b] for a, b in zip(cuts, cuts[1:])] if ids else [])
            # How many runs stand before the first mark; more than there are if it has none.
            leading.append(len(cuts) if not len(marks) else int(marks[0] > 0))
        self.learn(set().union(*runs))
        texts = []
        for ids, parts, before in zip(values, runs, leading):
            text = "".join(map(self.__getitem__, parts))
            # The mark at the start of a text stands for no space of it.
            unseen = before < len(parts) and not "".join(self[r] for r in parts[:before])
            texts.append(None if ids is None else text[1:] if unseen else text)
        return texts


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n`` of every distinct marked word of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                text_value = value.as_py()
                seen.update(marked_words(text_value))
                size += len(text_value or "")
                if len(seen) > FLUSH or size > 16 * BULK:
                    yield table(seen)
                    seen.clear()
                    size = 0
        yield table(seen)

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """The words from the lowest count on from which at most ``limit`` words remain; overlong ones stay out."""
    short = counts.where(F.octet_length("word") <= LONGEST)
    # One row for each eighth of a power of two that a count falls into.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r.step: r.words for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    cut, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > limit:
            break
        cut = k
    return short.where(step >= cut) if cut is not None else short.limit(0)


def segment_words(words: DataFrame, model: bytes) -> DataFrame:
    """``word``, ``ids`` (packed), ``surface`` (what they stand for) of a frame of distinct marked words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, surfaces = Segments(model, local=0), Surfaces(model, local=0)
        for batch in batches:
            names = batch.column(0).to_pylist()
            segments.learn(set(names))
            ids = [segments[w] for w in names]
            surfaces.learn(set(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([surfaces[i] for i in ids], pa.string())],
                names=["word", "ids", "surface"])

    return words.select("word").mapInArrow(run, "word string, ids binary, surface string")


def frequent_table(docs: DataFrame, model: bytes, text: str = "text", limit: int = FREQUENT) -> list[tuple[str, bytes, str]]:
    """Word, packed ids and surface of the frequent marked words, at most ``limit``."""
    # Words that occur once are segmented once where they stand.
    counts = checkpoint(count_words(docs, text).where("n > 1"))
    rows = segment_words(frequent_words(counts, limit), model).collect()
    return [(r.word, bytes(r.ids), r.surface) for r in rows]


def _with_column(docs: DataFrame, used: str, name: str, kind: T.DataType, make) -> DataFrame:
    """The frame with one more column; ``make()`` gives a task its function from values of ``used`` to the new ones."""
    place, arrow = docs.columns.index(used), {T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of = make()
        for batch in batches:
            start, size, values = 0, 0, []
            for k, value in enumerate(batch.column(place)):
                values.append(value.as_py())
                size += len(values[-1] or "")
                if size > BULK or k == batch.num_rows - 1:
                    kept = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(values_of(values), arrow)], names=[*batch.schema.names, name])
                    start, size, values = k + 1, 0, []

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text",
           begin: bool = True, end: bool = True, limit: int = FREQUENT) -> DataFrame:
    """The frame with the column ``ids``: each text's ids, packed as little-endian 32-bit integers."""
    model = read_model(path)
    processor = SentencePieceProcessor(model_proto=model)
    before = packed([processor.bos_id()] * begin)
    after = packed([processor.eos_id()] * end)
    shipped = docs.sparkSession.sparkContext.broadcast([(w, i) for w, i, _ in frequent_table(docs, model, text, limit)])

    def make():
        segments = Segments(model, shipped.value)
        return lambda texts: [before + ids + after for ids in segments.ids_of(texts)]

    return _with_column(docs, text, ids, T.BinaryType(), make)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The frame with the column ``text``: what packed ids stand for."""
    model = read_model(path)

    return _with_column(frame, ids, text, T.StringType(), lambda: Surfaces(model).texts_of)


def encoding_report(docs: DataFrame, path: str, limit: int = FREQUENT) -> DataFrame:
    """One row per document: number and digest of its ids, digest of the text decoded from them."""
    model = read_model(path)
    processor = SentencePieceProcessor(model_proto=model)
    before, after = packed([processor.bos_id()]), packed([processor.eos_id()])
    shipped = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, model, limit=limit))

    def make():
        segments = Segments(model, [(w, i) for w, i, _ in shipped.value])
        surfaces = Surfaces(model, [(i, t) for _, i, t in shipped.value])

        def digests(texts: list[str | None]) -> list[str]:
            ids = [before + i + after for i in segments.ids_of(texts)]
            return [f"{len(i) // 4} {sha256(i).hexdigest()} {sha256(t.encode()).hexdigest()}"
                    for i, t in zip(ids, surfaces.texts_of(ids))]
        return digests

    name = fresh(docs, "digests")
    parts = F.split(name, " ")
    return _with_column(docs.select("doc_id", "text"), "text", name, T.StringType(), make).select(
        "doc_id", parts[0].cast("bigint").alias("n_tokens"), parts[1].alias("ids_sha256"), parts[2].alias("decoded_sha256"))
