"""Every operator against a brute-force version, on rows with all odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from structlake.llm import decontaminate, langid, maxent, mixing, pii, quality, secrets_crf, shards, simhash
from structlake.operators.components import connected_components

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keyed(rows):
    return collections.Counter(rows)


# 9: quality rules

def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(odd_docs, odd_rows, labels):
    got = quality.quality_report(odd_docs, labels, trusted_limit=10).collect()
    want = keyed((r[0], *plain_measures(r[1])) for r in odd_rows)
    assert keyed((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)


def test_quality_ratio_tells_junk_apart(spark, labels):
    good = [(k, prose(k, 200), "en", "s", 1) for k in range(60)]
    junk = [(100 + k, " ".join(w.upper() + "!!" for w in prose(k + 500, 200).split()), "en", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(good + junk, SCHEMA)
    trusted = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(docs, trusted).collect()}
    assert kept == set(range(60))


def test_quality_without_labels_or_rows(odd_docs, empty_docs, labels):
    none = quality.quality_report(odd_docs, labels.limit(0)).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in none)
    assert quality.quality_report(empty_docs, labels).count() == 0


# 2: personal data

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, f) in PLAIN.items() for m in re.finditer(p, text or "") if f(m.group())]


def test_personal_data(spark, odd_rows):
    pick = random.Random(5)
    alphabet = "ab1234567890.@+-() \n_é%"
    noisy = [(100 + k, "".join(pick.choice(alphabet) for _ in range(300)), None, None, None) for k in range(150)]
    special = [(300, "a@b.c_d@e.f x@y x@y.z.", None, None, None), (301, "1.2.3.4.5.6.7.8 001.02.3.0004 999999999999.1.1.1", None, None, None),
               (302, " ".join(f"u{k}@h.io" for k in range(700)), None, None, None), (303, "a." * 20_000 + "9" * 20_000, None, None, None)]
    rows = odd_rows + noisy + special
    got = pii.personal_data_report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = keyed((r[0], hashlib.sha256(",".join(plain_pii(r[1])).encode()).hexdigest()) for r in rows)
    assert keyed((r.doc_id, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    text = {r[0]: r[1] for r in odd_rows}[14]
    found = {k: text[int(s):int(e)] for k, s, e in (x.split(":") for x in spans[14].split(","))}
    assert found == {"iban": "DE89370400440532013000", "ssn": "123-45-6789"}
    assert next(r for r in got if r.doc_id == 302).n_email == 700


# 5: sharding

@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 1025])
def test_permutation(spark, n):
    places = [r.p for r in spark.range(n).select(shards.permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(places) == list(range(n))


def test_shards(odd_docs, odd_rows, empty_docs):
    got = shards.shard_report(odd_docs).collect()
    assert keyed((r.doc_id, r.size, r.text_crc32) for r in got) == keyed(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    assert keyed(map(tuple, shards.shard_report(odd_docs.repartition(1)).collect())) == keyed(map(tuple, got))
    assert shards.shard_report(empty_docs).count() == 0


# 4: mixing

def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, fixed, total = {}, {}, sum(sizes.values())
    while True:
        rest, mass = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        target = {s: fixed.get(s, rest * w[s] / mass if mass else 0) for s in names}
        over = [s for s in names if s not in fixed and target[s] > most * sizes[s]]
        if not over:
            return target
        fixed |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def mix_rows():
    pick = random.Random(9)
    sources = ["a"] * 40 + ["b", "c", "d", None, "é", "B"] * 6 + ["tiny"]
    return [(k, prose(k, pick.choice([0, 3, 20, 90])) or None, "en", pick.choice(sources), 1) for k in range(700)] + [
        (7, prose(7, 20), "en", "a", 1)] * 3


def test_mixing(spark, mix_rows, empty_docs):
    docs = spark.createDataFrame(mix_rows, SCHEMA)
    got = mixing.mix_report(docs).collect()
    size_of = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in mix_rows:
        sizes[r[3]] += size_of(r[1])
    target = plain_targets(sizes)
    assert keyed((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in got) == keyed(
        (r[0], size_of(r[1]), sizes[r[3]], round(target[r[3]], 4)) for r in mix_rows)
    assert all(r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0) for r in got)
    taken = collections.Counter()
    for r in got:
        taken[(r.source_size, r.target)] += r.taken
    assert all(abs(n - t) <= max(20, 0.02 * t) for (_, t), n in taken.items())
    assert keyed(map(tuple, mixing.mix_report(docs.repartition(5)).collect())) == keyed(map(tuple, got))
    assert mixing.mix_report(empty_docs).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and sum(size_of(r.text) for r in copies.collect()) == sum(taken.values())


def test_pivotal_keeps_mass_and_expectation(spark):
    items = spark.range(1, 2001).select(F.lit(1).alias("source_id"), F.col("id").alias("n"),
                                        (F.col("id") % 37 + 1).alias("size"), F.lit(0.3).alias("p"))
    drawn = [mixing.pivotal(items, 2000, seed).join(items, "n").collect() for seed in (1, 2, 3)]
    total = sum((k % 37 + 1) for k in range(1, 2001))
    for rows in drawn:
        assert len(rows) == 2000 and abs(sum(r.extra * r["size"] for r in rows) - 0.3 * total) <= 37
    assert {r.n for r in drawn[0] if r.extra} != {r.n for r in drawn[1] if r.extra}


# 7: near-duplicates

def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(odd_docs, odd_rows, empty_docs):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    groups = collections.defaultdict(list)
    for row, g in zip(odd_rows, plain_components(prints)):
        groups[g].append(row[0])
    of = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = keyed((r[0], f"{p:016x}", of[g]) for r, p, g in zip(odd_rows, prints, plain_components(prints)))
    assert keyed(map(tuple, simhash.near_duplicate_report(odd_docs).collect())) == want
    kept = simhash.one_of_each(odd_docs)
    assert keyed(r.doc_id for r in kept.collect()) == keyed(of.values()) and kept.columns == odd_docs.columns
    assert simhash.near_duplicate_report(empty_docs).count() == 0


@pytest.mark.parametrize("group", [32, 1024])
def test_links_lose_no_pair(spark, group):
    pick = random.Random(11)
    centres = [pick.getrandbits(64) for _ in range(40)]
    prints = {c for x in centres for c in [x] + [x ^ (1 << pick.randrange(64)) ^ (pick.random() < 0.5) * (1 << pick.randrange(64)) for _ in range(12)]}
    # One crowd that agrees on most bits, so that nodes have to be cut again.
    prints |= {0xABCDEF << 40 | k << 3 for k in range(300)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame, group=group)).collect()}
    got = collections.defaultdict(set)
    for p in signed:
        got[roots.get(p, p)].add(p)
    want = collections.defaultdict(set)
    for p, g in zip(signed, plain_components(prints)):
        want[g].add(p)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges).collect()
    assert len(got) == 500 and {r.root for r in got} == {0}


# 10: decontamination

def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_and_candidates():
    pick = random.Random(3)
    index = decontaminate.Index.build([(k, "".join(pick.choice("abcde ") for _ in range(90))) for k in range(5)], 0.08)
    found = 0
    for trial in range(120):
        s = trial % 5
        text = [chr(c) for c in index.segments[s].tolist()]
        for _ in range(pick.randint(0, 10)):
            k = pick.randrange(len(text))
            text[k:k + 1] = pick.choice([["z"], [], [text[k], "y"]])
        before = "".join(pick.choice("abcde ") for _ in range(pick.randint(0, 200)))
        whole = before + "".join(text) + "qq"
        true = plain_distance("".join(map(chr, index.segments[s].tolist())), whole)
        hits = decontaminate.hits_in(whole, index)
        if true <= index.edits[s]:
            found += 1
            assert hits[s][1] == true
        else:
            assert s not in hits
    assert found > 40


def test_decontamination(spark, benchmark, odd_docs, odd_rows, empty_docs):
    item = prose(50, 30)
    worn = item.upper().replace(" ", "\n", 3)[:100] + item[103:]
    more = [(20, "before " + item + " after", "en", "s", 1), (21, worn, "en", "s", 1), (22, item[:140] + " tail", "en", "s", 1),
            (23, item[:60], "en", "s", 1)]
    docs = odd_docs.union(spark.createDataFrame(more, SCHEMA))
    hits = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(docs, benchmark).collect()}
    assert hits == {(None, 0), (9, 0), (10, 0), (20, 3), (21, 3), (22, 3)}
    assert hits == {(r.doc_id, r.item_id) for r in decontaminate.contaminated(
        docs.select("doc_id", "text"), benchmark, block_chars=10).collect()}
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    bad = {9, 10, 20, 21, 22}
    assert keyed(map(tuple, clean.collect())) == keyed(
        r for r in odd_rows + more if r[0] not in bad and not (r[0] is None and r[1]))
    assert decontaminate.contamination_report(empty_docs, benchmark).count() == 0
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == docs.count()


# 3: languages

def test_languages(spark, odd_docs, empty_docs):
    kinds = {"en": ["ther", "ing", "tion", "wh"], "de": ["ung", "sch", "heit", "ö"], "es": ["ción", "ñ", "rr", "os"]}
    rows = [(k, prose(k, 5 + k % 60, kinds[lang]), lang, "s", 1) for k, lang in enumerate(list(kinds) * 150)]
    docs = spark.createDataFrame(rows, SCHEMA).union(odd_docs.where("doc_id in (4, 5, 6, 13)"))
    got = langid.language_report(docs).collect()
    assert len(got) == len(rows) + 4
    known = {r[0]: r[2] for r in rows}
    right = [r.lang_pred == known[r.doc_id] for r in got if r.held_out and r.doc_id > 20]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    odd = langid.identify(odd_docs, langid.fit(docs)).collect()
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 13) or r.doc_id is None and r.score == 0) for r in odd)
    assert langid.language_report(empty_docs).count() == 0
    assert {r.lang_pred for r in langid.language_report(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8: secrets

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def plain_secrets(text):
    found = sorted((m.start(), n, k, m.end()) for n, (k, p, f) in enumerate(PATTERNS) for m in p.finditer(text or "") if f(m))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def test_secrets(spark, odd_rows, empty_docs):
    pick = random.Random(4)
    more = []
    for k in range(120):
        value = "".join(pick.choice("0123456789abcdef") for _ in range(pick.choice([6, 12, 20, 40])))
        lead = pick.choice(["password=", "API_KEY : '", "secret", "Token=", "x ", "see 2.0 and "])
        more.append((100 + k, f"{prose(k, 20)} {lead}{value} {prose(k + 1, 9)}", "en", "s", 1))
    rows = odd_rows + more
    got = secrets_crf.secret_report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = keyed((r[0], hashlib.sha256(plain_secrets(r[1]).encode()).hexdigest()) for r in rows)
    assert keyed((r.doc_id, r.base_sha256) for r in got) == want
    assert secrets_crf.secret_report(empty_docs).count() == 0


def test_field_learns_and_decodes_exactly():
    pick = random.Random(6)
    field, seen = secrets_crf.Field.empty(), np.zeros((1 << secrets_crf.BITS, 3))
    for _ in range(600):
        secret = pick.random() < 0.5
        token = "".join(pick.choice("0123456789abcdef") for _ in range(24)) if secret else str(pick.randrange(2000))
        text = f"set secret {token} now" if secret else f"in the year {token} it was"
        run = secrets_crf.stretches(text)[0]
        file = secrets_crf.file_features(text)
        field.learn([secrets_crf.features(text, s, e, file) for s, e in run], [1 if secret else 0] * len(run), seen, 0.5)
    assert secrets_crf.field_spans("my secret 0123abcd4567ef890123abcd and the year 1999", field) == [(10, 34)]
    rows = [[pick.randrange(1 << secrets_crf.BITS) for _ in range(4)] for _ in range(5)]
    field.emit[:] = np.random.default_rng(1).normal(size=field.emit.shape)
    field.move[[0, 1, 1, 2, 2], [1, 0, 2, 1, 2]] = [0.3, -0.2, 0.5, 0.1, -0.4]
    score = field.scores(rows)
    worth = lambda tags: sum(score[t, k] for t, k in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:]))
    best = max(np.ndindex(*[3] * 5), key=worth)
    assert field.decode(rows) == list(best)


# 1: language model

def test_language_model(spark, odd_rows, odd_docs, empty_docs):
    # Two languages that differ in their endings, which is what classes are made of.
    pick = random.Random(12)
    rows = odd_rows + [(100 + k, " ".join("".join(pick.choice("aeiou") for _ in range(3)) + pick.choice(
        ["ung", "heit", "lich"] if k % 2 else ["tion", "ther", "es"]) for _ in range(60)), "en", "s", 1) for k in range(400)]
    got = maxent.score(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    toks = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    count, texts = collections.Counter(), 0
    for i, w in toks:
        if not held(i):
            count.update(w)
            texts += 1
    n, v = sum(count.values()) + texts, len(count) + 1

    def base(words):
        return sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(count[w] for w in words), texts])

    want = keyed((i, held(i), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(base(w), 5)) for i, w in toks)
    assert keyed((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    test = [r for r in got if r.held_out and (r.doc_id or 0) >= 100]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert maxent.score(empty_docs).count() == 0


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(1 << maxent.BITS, maxent.CLASSES)).astype(np.float32)
    context = rng.integers(0, 1 << maxent.BITS, (20, maxent.SKIPS)).astype(np.int16)
    p = np.exp(maxent.log_softmax(weights, np.zeros(maxent.CLASSES, np.float32), context))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    words = [prose(k, 3) for k in range(40)]
    reader = maxent.Reader(["theaei"], np.array([3]))
    got = reader.read(words + [None])
    assert got["size"].tolist() == [4] * 40 + [1] and len(got["kind"]) == 161 and got["context"].shape == (161, 3)


def test_extra_columns_with_clashing_names(spark, odd_docs, labels, benchmark):
    clash = odd_docs
    for name in ("size", "row_key", "_key", "_ratios", "_quality", "_copies", "fp", "trusted", "bucket", "word", "root", "kept"):
        clash = clash.withColumn(name, F.lit(f"extra {name}"))
    for out in (quality.keep_good(clash, labels), simhash.one_of_each(clash),
                decontaminate.clean_documents(clash, benchmark), mixing.mixed_documents(clash)):
        assert out.columns == clash.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(f"extra {c}" for c in clash.columns[5:])}


def test_sample_share_never_rounds_to_nothing(spark):
    from structlake.llm.common import sampled_share, share_bound
    for rows in (10**5, 10**11, 10**14):
        expected = (share_bound(20_000, rows) + (1 << 63)) / (1 << 64) * rows
        assert abs(expected - 20_000) < 1
    assert share_bound(20_000, 20_000) is None and share_bound(5, 0) is None
    ids = spark.range(50_000)
    assert 800 < sampled_share(ids, F.col("id"), 1000).count() < 1200
    assert sampled_share(ids, F.col("id"), 50_000).count() == 50_000
