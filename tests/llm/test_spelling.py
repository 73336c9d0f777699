"""Variable grams: the bound must hold for every edit, and no near pair may be lost."""

import random
import re
import zlib
from collections import Counter

import pytest

from structlake.llm import spelling


def edits(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
            if k < len(word):
                yield word[:k] + c + word[k + 1:]
        if k < len(word):
            yield word[:k] + word[k + 1:]


def random_words(n, letters, seed, shortest=6, longest=11):
    pick, words = random.Random(seed), set()
    while len(words) < n:
        word = "".join(pick.choices(letters, k=pick.randrange(shortest, longest + 1)))
        words.add(word)
        words.add(pick.choice([e for e in edits(word, letters) if len(e) >= shortest]))
    return sorted(words)


def distance_one(a, b):
    return a != b and b in set(edits(a, set(b)))


def frequent_by_hand(words, shortest, longest, share):
    out = {}
    for q in range(shortest, longest + 1):
        counts = Counter(g for w in words for g in (spelling.closed(w)[k:k + q] for k in range(len(w) + 3 - q)))
        total = sum(counts.values())
        out |= {g: n for g, n in counts.items() if n * share > total}
    return out


@pytest.mark.parametrize("longest,share", [(2, 50), (3, 20), (4, 200), (5, 2000)])
def test_an_edit_affects_no_more_grams_than_the_bound_says(longest, share):
    words = random_words(300, "abcd", longest)
    dictionary = spelling.Dictionary(frequent_by_hand(words, 2, longest, share), 2, longest)
    for word in words[:80]:
        text = spelling.closed(word)
        grams = dictionary.decompose(text)
        bound = dictionary.affected(text, grams)
        named = Counter((text[a:b], a) for a, b in grams)
        for other in edits(word, "abcdx"):
            changed = spelling.closed(other)
            there = {(changed[a:b], a) for a, b in dictionary.decompose(changed)}
            shift = len(other) - len(word)
            kept = sum((g, a) in there or (g, a + shift) in there for g, a in named)
            assert kept >= len(grams) - bound, (word, other)


@pytest.mark.parametrize("letters,longest,share,crowd", [
    ("abcdefgh", 3, 1 << 12, 1 << 12), ("ab", 3, 40, 5), ("abc", 4, 4000, 50), ("abcé", 5, 4000, 3), ("abcdefgh", 2, 1, 1 << 12)])
def test_near_words_equal_brute_force(spark, letters, longest, share, crowd):
    words = random_words(250, letters, 7)
    near = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint"), 2, longest, share, crowd)
    known = set(words)
    expected = {(w, e) for w in words for e in edits(w, letters) if e in known and e != w}
    found = [tuple(r) for r in near.collect()]
    assert len(expected) > 100 and len(found) == len(set(found)) and set(found) == expected


def report_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 5}
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and distance_one(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def test_report_equals_brute_force(spark):
    pick, rows = random.Random(4), []
    base = ["Separate", "seperate", "separat", "separaate", "definitely", "definitly", "definetly", "ÉCLAIRÉ", "éclairé", "abcdef",
            "abcdeg", "short", "xxxxxxx", "xxxxxxxx", "xxxxxxxxx"]
    weights = [900, 90, 12, 8, 700, 70, 9, 40, 8, 60, 60, 50, 600, 60, 6]
    for k in range(400):
        rows.append((k, " ".join(pick.choices(base, weights, k=40)) + ("-" if k % 2 else "1")))
    rows += [(None, "separate definitely " * 3), (None, None), (5, ""), (6, "a b c"), (7, "separate " * 6000), (7, "separate " * 6000)]
    docs = spark.createDataFrame([(*r, "w", 2) for r in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    found = sorted((tuple(r) for r in spelling.variant_report(docs).collect()))
    expected = report_by_hand(rows)
    assert found == expected and any(r[1] and r[1] != r[2] for r in expected)


def test_columns_and_empty_table(spark, empty_docs):
    out = spelling.variant_report(empty_docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
