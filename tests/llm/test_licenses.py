import re

from palisade.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NOTICE = dict(reversed(licenses.NOTICES))


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


ROWS = [
    (1, "Released under the MIT License."), (2, "Apache License, Version 2.0; CC BY-NC 4.0 cc by nc"), (3, None), (4, ""), (5, "under the"),
    (6, "É under the mitK license cc by cc by nc"), (7, "under the mit license " * 400), (7, "under the mit license " * 400),
    (8, "x " * 30000 + "CC-BY-NC"), (9, "so " + NOTICE["bsd"].replace("binary forms", "binary code forms").upper() + " end"),
    (10, "Licensed under the GNU General Public License v3"), (None, "apache license version 2"), (11, "gnu general public"), (12, "...!"),
    (13, "under the m\u0130t license under the mit license \u212a cc by \u212a nc"),
]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "l") for r in ROWS], "doc_id long, text string, labels string")
    rows = licenses.scan(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert got == sorted(((k, *brute(t)) for k, t in ROWS), key=str)
    by = {r.doc_id: r for r in rows}
    assert by[9].labels == "bsd" and 0.7 <= by[9].score < 1 and by[10].labels == "gpl" and by[10].score == 1
    assert by[11].labels == "" and 0 < by[11].score < 0.7 and by[3].score == 0
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in rows)


def test_random(spark):
    import random

    rng = random.Random(0)
    vocab = "under the mit license apache version 2 cc by nc x".split()
    docs = [(i, " ".join(rng.choice(vocab) if rng.random() < 0.5 else rng.choice(licenses.BASE)[1] for _ in range(rng.randrange(40)))) for i in range(80)]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows if r.n_base) == sorted((k, *brute(t)) for k, t in docs if brute(t)[1])


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
