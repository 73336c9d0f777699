"""Every token of a text is in the chain: letters-only secrets, scores at once against one by one, cuts against Viterbi over all."""

import random

import numpy as np

from structlake.llm import secrets_crf

from .conftest import SCHEMA, prose


def letters(pick, n=12):
    return "".join(pick.choice("QWRTZPSDFGHJKLXCVBNM" if k % 2 else "qwrtzpsdfghjklxcvbnm") for k in range(n))


def test_secret_of_letters_only_is_found(spark):
    pick, rows = random.Random(7), []
    for k in range(400):
        lead = pick.choice(["password = ", "passwd: ", "secret=", "token = "])
        found = f"{lead}{letters(pick, pick.choice([10, 12, 14]))}" if k % 2 else "The Word of Many"
        rows.append((k, f"{prose(k, 25)} {found} {prose(1000 + k, 25)}", "en", "s", 1))
    value = letters(pick)
    text = f"{prose(2001, 12)} the passphrase is {value} {prose(2002, 12)}"
    plain = prose(2003, 60)
    rows += [(900, text, "en", "s", 1), (901, plain, "en", "s", 1)]
    got = {r.doc_id: r for r in secrets_crf.secret_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    at = text.index(value)
    assert got[900].spans == f"field:{at}:{at + len(value)}" and got[900].n_assign == 0
    assert got[901].spans == ""
    assert all(("field" not in r.spans) for k, r in got.items() if k < 400)


def test_scores_and_cuts_are_exact(odd_rows):
    rng = np.random.default_rng(5)
    field = secrets_crf.Field.empty()
    field.emit[:] = rng.normal(size=field.emit.shape)
    field.emit[:, 0] += 0.15
    field.move[[0, 1, 1, 1, 2, 2, 2], [1, 0, 1, 2, 0, 1, 2]] = [0.3, -0.2, 0.1, 0.5, 0.2, 0.1, -0.4]
    texts = [r[1] for r in odd_rows if r[1] and len(r[1]) < 5000] + ["é" + "abc_d+x İ " * 9 + "y" * 60 + " z/9 \ud800q"]
    sheet = secrets_crf.Sheet(texts)
    first = np.diff(sheet.text, prepend=-1) > 0
    score = field.scores_of(sheet.rows)
    labels, cut = field.decode_text(score, first), field.surely_outside(score).sum()
    assert cut > 50 and len(set(sheet.text)) > 8
    for k, text in enumerate(texts):
        starts, ends, _ = secrets_crf.tokens(text)
        assert sheet.starts[sheet.text == k].tolist() == starts.tolist() and sheet.ends[sheet.text == k].tolist() == ends.tolist()
        if len(starts):
            file = secrets_crf.file_features(text)
            want = field.scores([secrets_crf.features(text, s, e, file) for s, e in zip(starts.tolist(), ends.tolist())])
            assert np.allclose(score[sheet.text == k], want)
            assert labels[sheet.text == k].tolist() == field.best(want)
