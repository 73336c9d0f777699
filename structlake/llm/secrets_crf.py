"""Secrets in texts: plain patterns, and a linear-chain conditional random field.

Tokens are runs of letters, digits and ``_+/.-``.  The field tags every token
of a text as beginning, inside or outside a secret, from its shape, the words
beside it and features of the whole text.  The scores of all tokens are taken
at once; where they show that outside is best whatever the neighbours are, the
chain is cut, and Viterbi runs over what is in between.  That is exact for the
chain of the whole text.

The field is learned from what the plain patterns find in a bounded hash sample
of ``SAMPLE`` texts.  Of each it takes up to ``PER_TEXT`` stretches of at most
``PER_STRETCH`` tokens that hold a find, a digit or a long token, each with the
tokens beside it, and ``PLAIN`` tokens at any place.  What the patterns miss is
learned as outside; so that no text's misses are learned by heart, texts are
dealt to two halves by their content, and each is searched with the field of
the other half.  Every text is searched whole.  Spans of the patterns stay; the field's spans are added where they do
not overlap one.

Defined cases: null text is the empty text and has no span; repeated rows get
equal results; without a secret in the sample the field tags nothing; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import sampled_share

SAMPLE, PER_TEXT, LONG, BITS, EPOCHS = 8000, 4, 20, 14, 6
#: Tokens that are learned of a stretch, and of a text at any place; decoding takes all.
PER_STRETCH, PLAIN = 32, 4
#: Words beside a token begin and end within so many characters; so many of them count before and after it.
REACH, BEFORE, AFTER = 48, 4, 2
#: Weight for outside of a token like a word of prose before anything is learned.
PRIOR = 8.0
#: Characters of the texts that are read at once; between two of them no word is in reach of the other.
SHEET, GAP = 200_000, "\n" * (REACH + 1)
OUT, BEGIN, INSIDE = 0, 1, 2

#: The plain kinds.  Upper bounds on what is dropped are inside the patterns where a run is maximal.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("pass", "secret", "token", "api")
#: Parts of words that name a secret.
NAMING = re.compile("pass|secret|token|key|pwd|credential", re.I | re.A)
KINDS = ("assign", "access", "hex")

#: By code point below 128: part of a token, a digit.
_TOKEN = np.array([chr(c).isalnum() or chr(c) in "_+/.-" for c in range(128)])
_DIGIT = np.array([chr(c).isdigit() for c in range(128)])
_UPPER, _LOWER, _HEX = (np.array([chr(c) in signs for c in range(128)]) for signs in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"))
_CLASS = np.where(_UPPER, 1, np.where(_LOWER, 2, np.where(_DIGIT, 3, 4 + np.arange(128))))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: The row number of a feature that a token does not have.
NONE = 1 << BITS


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain kinds, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens of a text, and whether each has a digit or is long."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.minimum(points, 127)
    starts, ends = _edges(_TOKEN[code] & (points < 128))
    digits = _before(_DIGIT[code] & (points < 128))
    return starts, ends, (digits[ends] > digits[starts]) | (ends - starts >= LONG)


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask."""
    wide = np.zeros(len(inside) + 2, np.int8)
    wide[1:-1] = inside
    edges = np.flatnonzero(np.diff(wide))
    return edges[::2], edges[1::2]


def _before(mask: np.ndarray) -> np.ndarray:
    """How many of a mask are true before each place."""
    return np.concatenate([[0], np.cumsum(mask)])


def _runs(chosen: np.ndarray) -> list[np.ndarray]:
    """The places where a mask is true, cut into runs of neighbours."""
    places = np.flatnonzero(chosen)
    return np.split(places, np.flatnonzero(np.diff(places) > 1) + 1) if len(places) else []


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens with a digit or of some length, as (start, end)."""
    starts, ends, marked = tokens(text)
    return [[(int(starts[k]), int(ends[k])) for k in run] for run in _runs(marked)]


def file_features(text: str) -> list[str]:
    low = text.lower()
    named = "+".join(k for k in KEYWORDS if k in low)
    return [f"file:{named}", f"equals:{'=' in text}", f"length:{len(text).bit_length()}"]


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names]


def _feature(kind: int, value) -> np.ndarray:
    """Row numbers of the features of one kind, by their values."""
    mixed = (np.atleast_1d(value).astype(np.uint64) + np.uint64(kind << 56)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int32)


class Sheet:
    """All tokens of some texts: ``text`` (its number), ``starts`` and ``ends`` in it, ``marked``, and ``rows`` of feature numbers.

    A token's features are its form (runs of capitals, small letters, digits
    and other signs), size, kinds of signs, changes, head, hex digits and dots,
    the words or marks beside it, whether one before it names a secret, and
    those of its text.  Strings are told apart by polynomial hashes.
    """

    def __init__(self, texts: list[str]):
        whole = GAP.join(texts)
        self.points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        plain = self.points < 128
        self.code = np.where(plain, self.points, 127)
        self.plain = plain
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(self.points), _BASE)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(self.points), _UNBASE)]))
        starts, ends = _edges(_TOKEN[self.code] & plain)
        sizes = np.array([len(t) for t in texts], np.int64) + len(GAP)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.text = np.searchsorted(first, starts, "right") - 1
        self.starts, self.ends = starts - first[self.text], ends - first[self.text]
        own = self._own(starts, ends)
        beside, named = self._beside(whole, starts, ends)
        size, odd = ends - starts, self.odd
        file = np.array([_hashed(file_features(t)) for t in texts], np.int32).reshape(-1, 3)
        self.rows = np.column_stack([
            *own, _feature(9, named), _feature(10, named + 2 * odd + 64 * np.minimum(size // 4, 6)), *beside, file[self.text]])

    def _hash(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the values in each range of places."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * self.powers[:-1])])
        return (total[ends] - total[starts]) * self.back[starts]

    def _own(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        def count(mask):
            n = _before(mask)
            return n[ends] - n[starts]

        size, code = ends - starts, self.code
        signs = _CLASS[code]
        capitals, small, digits = (count(kind[code] & self.plain) for kind in (_UPPER, _LOWER, _DIGIT))
        inner = capitals - (_UPPER[code] & self.plain)[starts] > 0
        mixed = (capitals > 0) + 2 * (small > 0) + 4 * (digits > 0)
        self.odd = mixed + 8 * inner
        self.marked = (digits > 0) | (size >= LONG)
        # The first sign of every run, hashed by its number among the runs.
        turn = np.diff(signs, prepend=-1) != 0
        turn[starts] = True
        at = _before(turn)
        runs = at[ends] - at[starts]
        places = np.flatnonzero(turn)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(signs[places].astype(np.uint64) * self.powers[:len(places)])])
        until = at[starts] + np.minimum(runs, 12)
        form = (total[until] - total[at[starts]]) * self.back[at[starts]]
        other = np.diff(code.astype(np.int64), prepend=-1) != 0
        head = self._hash(code + 1, starts, np.minimum(starts + 4, ends))
        eighth = np.minimum(size // 8, 6)
        ordinary = (size < LONG) & (digits == 0) & (~inner | (small == 0) & (size < 2)) & (count(code == 46) == 0)
        return [np.repeat(_feature(0, 0), len(starts)), _feature(1, form), _feature(2, np.minimum(size // 4, 12)), _feature(3, mixed),
                _feature(4, mixed + 8 * eighth), _feature(5, np.minimum(count(other) // 3, 7)), _feature(6, head),
                _feature(7, count(_HEX[code] & self.plain) == size), _feature(8, np.minimum(count(code == 46), 3)),
                _feature(11, ordinary)]

    def _beside(self, whole: str, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Features of the words before each token, nearest first, and after it; and whether one before it names a secret."""
        letter, space = np.array([chr(c).isalnum() for c in range(128)])[self.code], np.array(
            [chr(c).isspace() for c in range(128)])[self.code]
        letter, space = letter & self.plain, space & self.plain
        if not self.plain.all():
            odd = np.flatnonzero(~self.plain)
            signs, which = np.unique(self.points[odd], return_inverse=True)
            letter[odd] = np.array([chr(c).isalnum() for c in signs])[which]
            space[odd] = np.array([chr(c).isspace() for c in signs])[which]
        first, last = _edges(letter)
        marks = np.flatnonzero(~letter & ~space & (self.points != 95))
        w_starts, w_ends = np.concatenate([first, marks]), np.concatenate([last, marks + 1])
        order = np.argsort(w_starts, kind="stable")
        w_starts, w_ends = w_starts[order], w_ends[order]
        n, none = len(w_starts), []
        if not n:
            return [np.full(len(starts), NONE, np.int32)] * (2 * BEFORE + AFTER), np.zeros(len(starts), bool)
        low = self.points + 32 * (_UPPER[self.code] & self.plain)
        word = self._hash(low + 1, w_starts, w_ends)
        naming = np.zeros(n, bool)
        found = np.array([m.span() for m in NAMING.finditer(whole)], np.int64).reshape(-1, 2)
        holder = np.searchsorted(w_starts, found[:, 0], "right") - 1
        naming[holder[(holder >= 0) & (w_ends[holder.clip(0)] >= found[:, 1])]] = True
        named = np.zeros(len(starts), bool)
        end_at, start_at = np.searchsorted(w_ends, starts, "right"), np.searchsorted(w_starts, ends)
        for k in range(BEFORE):
            at = end_at - 1 - k
            has = (at >= 0) & (w_starts[at.clip(0)] >= starts - REACH)
            at = at.clip(0)
            named |= has & naming[at]
            none += [np.where(has, _feature(16 + k, word[at]), NONE), np.where(has, _feature(15, word[at]), NONE)]
        for k in range(AFTER):
            at = (start_at + k).clip(0, n - 1)
            has = (start_at + k < n) & (w_ends[at] <= ends + REACH)
            none.append(np.where(has, _feature(32 + k, word[at]), NONE))
        return none, named


def features(text: str, start: int, end: int, file: list[str]) -> list[int]:
    """Hashed features of one token in its text."""
    sheet = Sheet([text])
    row = sheet.rows[np.flatnonzero(sheet.starts == start)[0], :-3]
    return [*row[row < NONE].tolist(), *_hashed(file)]


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + log(sum(exp(y - top) for y in x))


@dataclass
class Field:
    """Weights: features x labels, and label to label; inside cannot follow outside or a text's start.

    A word of prose starts out as outside; that is a weight like others, which learning and the other features can outdo.
    """
    emit: np.ndarray
    move: np.ndarray

    @classmethod
    def empty(cls) -> "Field":
        move = np.zeros((3, 3))
        move[OUT, INSIDE] = -1e6
        emit = np.zeros((1 << BITS, 3))
        emit[_feature(11, True), OUT] = PRIOR
        return cls(emit, move)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        out = np.array([self.emit[r].sum(axis=0) for r in rows])
        out[0, INSIDE] = -1e6
        return out

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        return self.best(self.scores(rows))

    def best(self, score: np.ndarray, follows: bool = False, precedes: bool = False) -> list[int]:
        """The most likely labels by the tokens' scores; the stretch may follow and precede a token outside."""
        move = self.move.tolist()
        now = (score[0] + self.move[OUT] if follows else score[0]).tolist()
        back = []
        for row in score[1:].tolist():
            from_ = [max((now[a] + move[a][b], -a) for a in range(3)) for b in range(3)]
            back.append([-a for _, a in from_])
            now = [best + x for (best, _), x in zip(from_, row)]
        if precedes:
            now = [x + move[a][OUT] for a, x in enumerate(now)]
        labels = [now.index(max(now))]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def surely_outside(self, score: np.ndarray) -> np.ndarray:
        """Where outside beats both other labels whatever the labels beside it are.

        A path with another label there gains by outside, its next label turned from inside to beginning.
        """
        move, n = self.move, len(score)
        later = np.append(score[1:, BEGIN] - score[1:, INSIDE], np.inf) + min(0.0, (move[BEGIN] - move[INSIDE]).min())
        sure = np.ones(n, bool)
        for x in (BEGIN, INSIDE):
            gain = score[:, OUT] - score[:, x] + min(0.0, (move[:, OUT] - move[:, x]).min())
            kept = min(0.0, (move[OUT] - move[x])[[OUT, BEGIN]].min())
            sure &= gain + np.minimum(kept, move[OUT, BEGIN] - move[x, INSIDE] + later) > 0
        return sure

    def decode_text(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most likely labels of whole texts, whose first tokens are given, by Viterbi between tokens that are surely outside."""
        score[first, INSIDE] = -1e6
        labels = np.full(len(score), OUT)
        for run in _runs(~self.surely_outside(score)):
            for part in np.split(run, np.flatnonzero(first[run[1:]]) + 1):
                precedes = part[-1] + 1 < len(score) and not first[part[-1] + 1]
                labels[part] = self.best(score[part], not first[part[0]], precedes)
        return labels

    def scores_of(self, rows: np.ndarray) -> np.ndarray:
        """``scores`` of a matrix of feature numbers."""
        emit = np.append(self.emit, np.zeros((1, 3)), axis=0)
        total = emit[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            total += emit.take(rows[:, k], axis=0)
        return total

    def learn(self, rows: list[list[int]], labels: list[int], seen: np.ndarray, rate: float) -> None:
        """One step along the gradient of the log-likelihood of a stretch."""
        score, n = self.scores(rows), len(rows)
        # Three labels are too few for array calls to pay.
        move, rows_ = self.move.tolist(), score.tolist()
        ahead, behind = [rows_[0]], [[0.0] * 3]
        for row in rows_[1:]:
            last = ahead[-1]
            ahead.append([x + _log_sum([last[a] + move[a][b] for a in range(3)]) for b, x in enumerate(row)])
        for row in rows_[:0:-1]:
            next_ = [x + y for x, y in zip(row, behind[-1])]
            behind.append([_log_sum([m + y for m, y in zip(move[a], next_)]) for a in range(3)])
        total = _log_sum(ahead[-1])
        ahead, behind = np.array(ahead), np.array(behind[::-1])
        error = -np.exp(ahead + behind - total)
        error[np.arange(n), labels] += 1
        flat = np.array([f for row in rows for f in row], np.int64)
        each = np.repeat(error, [len(row) for row in rows], axis=0)
        np.add.at(seen, flat, each ** 2)
        np.add.at(self.emit, flat, rate * each / np.sqrt(1 + seen[flat]))
        if n > 1:
            step = -np.exp(ahead[:-1, :, None] + self.move + (score[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
            np.add.at(step, (labels[:-1], labels[1:]), 1)
            step[OUT, INSIDE] = 0
            self.move += rate * 0.1 * step


def value_spans(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The secret itself of each plain span: of an assignment what stands on its right."""
    return [(ASSIGN.match(text, s).start(2) if k == "assign" else s, e) for s, e, k in spans]


def labels_of(run: list[tuple[int, int]], values: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens by the secrets of the plain spans: a token with an end inside one."""
    out, last = [], None
    for start, end in run:
        owner = next(((s, e) for s, e in values if s <= start and end <= e or start < e <= end), None)
        out.append(OUT if owner is None else INSIDE if owner == last else BEGIN)
        last = owner
    return out


def examples_of(text: str) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the stretches of one text that are learned."""
    sheet = Sheet([text])
    starts, ends, marked = sheet.starts, sheet.ends, sheet.marked.copy()
    if not len(starts):
        return []
    values = value_spans(text, plain_spans(text))
    for s, e in values:
        marked |= (starts < e) & (ends > s)
    runs = [run[:PER_STRETCH] for run in _runs(marked)]
    runs.sort(key=lambda run: zlib.crc32(text[starts[run[0]]:ends[run[0]]].encode("utf-8", "surrogatepass")))
    chosen = [range(max(run[0] - 1, 0), min(run[-1] + 2, len(starts))) for run in runs[:PER_TEXT]]
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(starts) - PLAIN + 1)
    chosen.append(range(at, min(at + PLAIN, len(starts))))
    out = []
    for run in chosen:
        places = slice(run[0], run[-1] + 1)
        out.append(([row[row < NONE].tolist() for row in sheet.rows[places]],
                    labels_of(list(zip(starts[places].tolist(), ends[places].tolist())), values)))
    return out


def half_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) >> 7 & 1


def _examples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([(half_of(text or ""), *x) for text in frame["text"] for x in examples_of(text or "")],
                           columns=["half", "rows", "labels"])


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> list[Field]:
    """For each half of the texts the field learned from the other half of a bounded sample.

    At most ``sample * (PER_TEXT + 1)`` short stretches reach the driver.
    """
    chosen = sampled_share(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), F.col("doc_id"), sample)
    examples = chosen.select("text").mapInPandas(_examples, "half int, rows array<array<int>>, labels array<int>").collect()
    return [learned(sorted((list(map(list, r.rows)), list(r.labels)) for r in examples if r.half != half), epochs)
            for half in (0, 1)]


def learned(examples: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Field:
    field = Field.empty()
    if not any(any(labels) for _, labels in examples):
        return field
    seen = np.zeros_like(field.emit)
    order = np.random.default_rng(8)
    for epoch in range(epochs):
        for k in order.permutation(len(examples)):
            field.learn(*examples[k], seen, 0.5 / (1 + epoch / 2))
    return field


def spans_in(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """Spans that the field tags as secrets in whole texts that are read at once."""
    sheet, found = Sheet(texts), [[] for _ in texts]
    if not len(sheet.starts):
        return found
    labels = field.decode_text(field.scores_of(sheet.rows), np.diff(sheet.text, prepend=-1) > 0)
    for k in np.flatnonzero(labels != OUT):
        own, start, end = found[sheet.text[k]], int(sheet.starts[k]), int(sheet.ends[k])
        if labels[k] == BEGIN:
            own.append((start, end))
        else:
            own[-1] = (own[-1][0], end)
    return found


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags as secrets in a whole text."""
    return spans_in([text], field)[0]


def secrets_in(texts: list[str | None], fields: list[Field]) -> list[list[tuple[int, int, str]]]:
    """Of each text the plain spans, and its field's spans (kind ``field``) that overlap none, by start."""
    texts = [t or "" for t in texts]
    half = np.array([half_of(t) for t in texts], np.int64)
    # A sheet has texts of one half.
    sheets = 2 * (np.cumsum([len(t) + len(GAP) for t in texts]) // SHEET) + half
    rank = {k: n for n, k in enumerate((*KINDS, "field"))}
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for sheet in np.unique(sheets):
        some = np.flatnonzero(sheets == sheet)
        for at, tagged in zip(some, spans_in([texts[k] for k in some], fields[sheet % 2])):
            plain = plain_spans(texts[at])
            starts = [x for x, _, _ in plain]
            reach = list(accumulate((y for _, y, _ in plain), max))

            def clear(s: int, e: int) -> bool:
                before = bisect_left(starts, e)
                return not before or reach[before - 1] <= s

            added = [(s, e, "field") for s, e in tagged if clear(s, e)]
            out[at] = sorted(plain + added, key=lambda x: (x[0], rank[x[2]]))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: counts, digest of the plain spans, and all spans as text."""
    shipped = docs.sparkSession.sparkContext.broadcast([vars(field) for field in fit(docs, sample)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Field(**x) for x in shipped.value]
        for frame in frames:
            found = secrets_in(frame.pop("text").tolist(), known)
            plain = [[x for x in spans if x[2] != "field"] for spans in found]
            yield frame.assign(
                **{f"n_{k}": [sum(x[2] == k for x in spans) for spans in found] for k in KINDS},
                base_sha256=[hashlib.sha256(listed(p).encode()).hexdigest() for p in plain],
                spans=[listed(s) for s in found])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
