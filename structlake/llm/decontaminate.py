"""Benchmark passages in documents, found by counting shared q-grams.

Every benchmark item is cut into overlapping segments; a segment occurs in a
document if some substring is within ``rate`` edits per character of it.  By
the q-gram lemma such a substring shares ``m + 1 - q * (e + 1)`` q-grams with a
segment of m characters and e edits, all within e diagonals.  So the q-grams of
a document that also stand in the benchmark are counted in bands of diagonals
that overlap by half; bands that reach the bound are verified by an alignment
within the band.

Shorter excerpts cover no such segment, so items are also held whole against
the documents: where the q-grams shared along a band of diagonals suffice for
one of the item's pieces of ``PIECE`` characters, one at every ``STEP``, that
piece is aligned.  Every excerpt of ``EXCERPT`` characters covers a piece.

The benchmark is read in blocks of bounded size, each held against all
documents: what is shipped to the tasks does not grow with either table.

Characters are compared with A-Z in lower case and ASCII white space as a blank.
Defined cases: null texts and items are skipped; items of fewer than ``Q``
characters cannot be told from chance and have no hit; repeated documents and
items each get their rows; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fresh, row_key

Q, RATE = 10, 0.08
#: Longer items are cut into segments of this length, one at every STRIDE characters.
SEGMENT, STRIDE = 120, 60
#: Pieces that excerpts are found by, one at every STEP characters and at the end; any EXCERPT characters cover one.
PIECE, STEP = 66, 4
EXCERPT = PIECE + STEP - 1
#: Characters of benchmark text held against the documents at a time.
BLOCK_CHARS = 1_000_000


def _fold(points: np.ndarray) -> np.ndarray:
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    return np.where((points >= 9) & (points <= 13), 32, points).astype(np.uint64)


_FOLDED = _fold(np.arange(1 << 16))


def folded(text: str) -> np.ndarray:
    """Code points with A-Z lowered and white space as a blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(points) and points.max() >= len(_FOLDED):
        return _fold(points)
    return _FOLDED[points]


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at every place, built by doubling."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    factor, value, width, done, out = 0x9E3779B97F4A7C15, points, 1, 0, None
    while True:
        if q >> (width.bit_length() - 1) & 1:
            part = value[done:]
            out = part if out is None else out[: len(part)] * np.uint64(0xC2B2AE3D27D4EB4F) + part[: len(out)]
            done += width
        if width * 2 > q:
            break
        value = value[:-width] * np.uint64(factor) + value[width:]
        factor = (factor * factor + 2) % (1 << 64)
        width *= 2
    return out[: len(points) - q + 1]


@dataclass
class Index:
    """The q-grams of a block of benchmark segments."""
    segments: list[np.ndarray]
    items: np.ndarray
    offsets: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray
    #: Distinct q-grams in order, and where the owners and places of each begin.
    grams: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    #: Length of the longest segment.
    reach: int

    @classmethod
    def build(cls, rows: list[tuple[int, str]], rate: float, whole: bool = False) -> "Index":
        """Of segments, or of ``whole`` items, with the edits and bound of a piece."""
        segments, items, offsets = [], [], []
        for number, (_, text) in enumerate(rows):
            points = folded(text)
            if whole:
                if len(points) >= PIECE:
                    segments.append(points)
                    items.append(number)
                    offsets.append(0)
                continue
            last = max(0, len(points) - SEGMENT)
            for start in [*range(0, last, STRIDE), last]:
                if len(points) >= Q:
                    segments.append(points[start:start + SEGMENT])
                    items.append(number)
                    offsets.append(start)
        lengths = np.array([len(s) for s in segments], np.int64)
        needed = np.full_like(lengths, PIECE) if whole else lengths
        # No more edits than leave one shared q-gram for sure.
        edits = np.minimum((needed * rate).astype(np.int64), needed // Q - 1)
        grams = [gram_hashes(s) for s in segments]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        bits = min(25, max(12, int(len(flat) * 32).bit_length()))
        sieve = np.zeros(1 << bits, bool)
        sieve[(flat >> np.uint64(64 - bits)).astype(np.int64)] = True
        grams, begin = np.unique(flat[order], return_index=True)
        return cls(segments, np.array(items, np.int64), np.array(offsets, np.int64), edits,
                   needed + 1 - Q * (edits + 1), grams, np.append(begin, len(flat)), owner[order], place[order], sieve,
                   int(lengths.max(initial=0)))

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(segment, first diagonal of a band, places in the segment) that hold enough shared q-grams."""
        if not len(hashes) or not len(self.grams):
            return
        shift = np.uint64(64 - (len(self.filter).bit_length() - 1))
        at = np.flatnonzero(self.filter[(hashes >> shift).astype(np.int64)])
        if not len(at):
            return
        slot = np.searchsorted(self.grams, hashes[at])
        there = self.grams[np.minimum(slot, len(self.grams) - 1)] == hashes[at]
        at, slot = at[there], slot[there]
        low, n = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        if not len(at):
            return
        doc_at = np.repeat(at, n)
        post = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        segment, place = self.owner[post], self.place[post]
        diagonal = doc_at - place + self.reach  # never negative
        width = self.edits[segment] + 1
        band = diagonal // width
        # Bands take two widths of diagonals each and overlap by one.
        keys = np.concatenate([segment << 40 | band, segment << 40 | np.maximum(band - 1, 0)])
        order = np.argsort(keys, kind="stable")
        places = np.concatenate([place, place])[order]
        found, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
        owner = found >> 40
        enough = counts >= self.bounds[owner]
        for key, s, k, n in zip(*(x[enough].tolist() for x in (found, owner, first, counts))):
            yield s, (key & ((1 << 40) - 1)) * int(self.edits[s] + 1) - self.reach, places[k:k + n]


def aligned(segment: np.ndarray, text: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
    """Fewest edits between the segment and a substring of the text, along diagonals first..last.

    Returns (edits, start, end).  Row i of the band holds, for each diagonal d,
    the cost of the segment's first i characters ending before text place i + d;
    any start within the band is free.
    """
    far, n, width = 1 << 20, len(text), last - first + 1
    steps = np.arange(width)
    ends = first + steps
    cost = np.where((ends >= 0) & (ends <= n), 0, far)
    start = ends.copy()
    for i, sign in enumerate(segment.tolist(), 1):
        ends = i + first + steps
        inside = (ends >= 1) & (ends <= n)
        match = np.where(inside, text[np.clip(ends - 1, 0, n - 1)] != sign, 1)
        best = np.where(inside, cost + match, far)
        begin = start
        # The segment's sign is left out: from the next diagonal of the row before.
        skipped = np.append(cost[1:], far) + 1
        skipped = np.where((ends >= 0) & (ends <= n), skipped, far)
        begin = np.where(skipped < best, np.append(start[1:], 0), begin)
        best = np.minimum(best, skipped)
        # A sign of the text is left out: along the row, as a running minimum.
        level = best - steps
        run = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == run, steps, 0))
        cost, start = np.where((ends >= 0) & (ends <= n), run + steps, far), begin[source]
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), len(segment) + first + k


def fewest_edits(pieces: np.ndarray, text: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """As the edits of ``aligned``, for many pieces of equal length at once, each along ``width`` diagonals."""
    far, n, steps = 1 << 20, len(text), np.arange(width)
    ends = first[:, None] + steps
    cost = np.where((ends >= 0) & (ends <= n), 0, far)
    last = np.full((len(pieces), 1), far)
    for sign in pieces.T:
        ends = ends + 1
        valid = (ends >= 0) & (ends <= n)
        match = cost + (text[np.clip(ends - 1, 0, n - 1)] != sign[:, None])
        best = np.minimum(np.where(valid & (ends >= 1), match, far), np.concatenate([cost[:, 1:], last], axis=1) + 1)
        cost = np.where(valid, np.minimum.accumulate(np.where(valid, best, far) - steps, axis=1) + steps, far)
    return cost.min(axis=1)


def placed(segment: np.ndarray, text: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
    """As ``aligned``; a segment that stands there unchanged is found by a plain search."""
    low, m = max(0, first), len(segment)
    region, part = text[low:last + m].tobytes(), segment.tobytes()
    at = region.find(part)
    while at >= 0 and at % 8:
        at = region.find(part, at + 1)
    if at >= 0:
        return 0, low + at // 8, low + at // 8 + m
    return aligned(segment, text, first, last)


def pieces_in(points: np.ndarray, hashes: np.ndarray, wholes: Index,
              known: dict[int, dict[int, tuple[int, int, int]]]) -> dict[int, dict[int, tuple[int, int, int]]]:
    """By item that is not yet known, by piece: (edits, start, end) of the pieces of items in a text."""
    found: dict[int, dict[int, tuple[int, int, int]]] = {}
    for s, first, places in wholes.candidates(hashes):
        item, whole, e = int(wholes.items[s]), wholes.segments[s], int(wholes.edits[s])
        if item in known:
            continue
        last = len(whole) - PIECE
        starts = np.array([*range(0, last, STEP), last])
        # A repeated q-gram of the text counts once for each place in the item.
        places = np.unique(places)
        shared = np.searchsorted(places, starts + PIECE - Q, side="right") - np.searchsorted(places, starts)
        starts = starts[shared >= wholes.bounds[s]]
        if not len(starts):
            continue
        edits = fewest_edits(whole[starts[:, None] + np.arange(PIECE)], points, first + starts, 2 * e + 2)
        starts, edits = starts[edits <= e].tolist(), edits[edits <= e].tolist()
        # The first and the last piece give the passage; those in between are counted.
        ends = {start: placed(whole[start:start + PIECE], points, first + start, first + start + 2 * e + 1)
                for start in starts[:1] + starts[-1:]}
        for start, cost in zip(starts, edits):
            of_item, hit = found.setdefault(item, {}), ends.get(start, (cost, *ends[starts[0]][1:]))
            of_item[start] = min(of_item.get(start, hit), hit)
    return found


def hits_in(text: str, index: Index, wholes: Index | None = None) -> dict[int, tuple[int, int, int, int]]:
    """By item: (matched segments, fewest edits, start, end) of the passages in a text.

    Items without a matched segment are looked for by pieces if ``wholes`` is given; the pieces count as segments then.
    """
    points = folded(text)
    hashes = gram_hashes(points)
    found: dict[int, dict[int, tuple[int, int, int]]] = {}
    for s, first, _ in index.candidates(hashes):
        e = int(index.edits[s])
        edits, start, end = placed(index.segments[s], points, first, first + 2 * e + 1)
        if edits <= e:
            of_item = found.setdefault(int(index.items[s]), {})
            of_item[s] = min(of_item.get(s, (edits, start, end)), (edits, start, end))
    if wholes:
        found |= pieces_in(points, hashes, wholes, found)
    return {item: (len(by), *min(by.values())[:1], min(x[1] for x in by.values()), max(x[2] for x in by.values()))
            for item, by in found.items()}


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    rows, n = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        rows.append((row.item_id, row.text))
        n += len(row.text)
        if n >= block_chars:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_segments``, ``edits``, ``start``, ``end`` of every item found in a row of ``docs``.

    ``docs`` needs ``text`` and the columns to carry; start and end are code
    points, from the first to the last passage of the item.
    """
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c != "text"]
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + (
        f", item_id {item_type}, n_segments int, edits int, start bigint, end bigint")
    out = spark.createDataFrame([], schema)
    for rows in _blocks(benchmark, block_chars):
        shipped = spark.sparkContext.broadcast([vars(Index.build(rows, rate, whole)) for whole in (False, True)])
        ids = spark.sparkContext.broadcast([r[0] for r in rows])

        def run(frames: Iterator[pd.DataFrame], shipped=shipped, ids=ids) -> Iterator[pd.DataFrame]:
            index, wholes = (Index(**x) for x in shipped.value)
            for frame in frames:
                at, hits = [], []
                for k, text in enumerate(frame["text"]):
                    for item, values in hits_in(text, index, wholes).items() if text else ():
                        at.append(k)
                        hits.append((ids.value[item], *values))
                more = pd.DataFrame(hits, columns=["item_id", "n_segments", "edits", "start", "end"])
                yield pd.concat([frame[carried].iloc[at].reset_index(drop=True), more], axis=1)

        out = out.union(docs.select(*carried, "text").mapInPandas(run, schema))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return contaminated(docs.select("doc_id", "text"), benchmark)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any benchmark passage, unchanged."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key(docs))
    hit = contaminated(keyed.select(F.col(key).alias("row_key"), "text"), benchmark).select(
        F.col("row_key").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*docs.columns)
