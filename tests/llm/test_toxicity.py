import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from palisade.llm import toxicity as t
from palisade.llm.common import fold

BAD = ["idiot", "scum", "moron"]


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "re"]) for _ in range(3))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) if rng.random() < 0.6 else "vequ" + word())
        docs.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    w = t.train(df, marks, training=fold() != 0)
    rows = t.score(df, w).join(marks, "doc_id").filter(fold() == 0).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in rows) / len(rows)
    assert len(rows) > 60 and right > 0.97


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = marks.withColumn("toxic", F.when(fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert t.train(df, marks, training=fold() != 0) == t.train(df, turned, training=fold() != 0)


def test_odd_rows(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame([(i, x, "k") for i, x in [*docs, (None, "idiot"), (1000, None), (1001, ""), (1001, "")]], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (1000, None), (None, 1)], "doc_id long, toxic int")
    w = t.train(df, marks)
    out = t.score(df, w)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 304
    assert out.filter("score is null or score < 0 or score > 1").count() == 0
    assert len({r.score for r in out.filter("coalesce(text, '') = ''").collect()}) == 1


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    w = t.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert w is None and [r.score for r in t.score(df, w).collect()] == [0.0]
    assert t.score(df.limit(0), w).collect() == []


def plain_features(text):
    out = set()
    for w in re.split(r"[\W_]+", (text or "").lower()):
        if w:
            out.add(w)
            out |= {str(n) + w[:n] for n in (3, 4, 5, 6, 7, 8) if n < len(w)}
    return out


def test_features():
    for text in (None, "", "A_b c1 été! ÉTÉ longerwordhere x", "\n\t", "it's " * 3):
        assert t.features(text) == plain_features(text)


def test_gradient_is_that_of_the_risk():
    """By differences of the risk itself, computed text by text; above and below the bound."""
    rng = random.Random(1)
    p, u = ([[i for i in range(a, a + 4) if rng.random() < 0.6] for _ in range(n)] for a, n in ((0, 9), (2, 14)))
    prior = 0.3

    def parts(x):
        soft = lambda v: max(v, 0) + math.log1p(math.exp(-abs(v)))
        z = lambda s: sum(x[i] for i in s) + x[-1]
        mean = lambda values: sum(values) / len(values)
        toxic = prior * mean([soft(-z(s)) for s in p])
        clean = mean([soft(z(s)) for s in u]) - prior * mean([soft(z(s)) for s in p])
        return toxic, clean

    seen = set()
    for scale in (0.1, 1, 2):
        for k in range(12):
            x = np.random.default_rng(k).normal(size=7) * scale + (k % 2) * np.array([5, 5, 0, 0, -5, -5, 0.0])
            toxic, clean = parts(x)
            seen.add(bool(clean >= -prior))
            risk = (lambda y: sum(parts(y))) if clean >= -prior else (lambda y: -parts(y)[1])
            step = np.eye(7) * 1e-6
            want = [(risk(x + d) - risk(x - d)) / 2e-6 for d in step]
            assert np.allclose(t.Sample(p, u, 6, prior).gradient(x[:-1], x[-1]), want, atol=1e-6)
    assert seen == {True, False}


def test_chosen_features_and_scores_equal_brute_force(spark):
    docs, labels = corpus(400)
    docs += [(9000, None), (9001, "idiot " * 3), (9001, "scum")]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    w = t.train(df, marks)
    y = dict(labels)
    prior = sum(y.values()) / len(y)
    sides = [[plain_features(x) for k, x in docs], [plain_features(x) for k, x in docs if y.get(k) == 1]]
    names = {}
    for f in set().union(*sides[1]):
        in_u, in_p = (sum(f in s for s in side) for side in sides)
        a, b = (in_p + 0.5) / (len(sides[1]) + 1), (in_u + 0.5) / (len(sides[0]) + 1)
        z = (a - b) / math.sqrt(a * (1 - a) / len(sides[1]) + b * (1 - b) / len(sides[0]))
        if in_p >= 3 and z > t.STANDS_OUT and prior * a / b >= t.PURITY:
            names[f] = z
    assert set(w) == {*names, ""} and len(names) > 3
    for r in t.score(df, w).collect():
        assert abs(r.score - 1 / (1 + math.exp(-(w[""] + sum(w[f] for f in plain_features(r.text) & w.keys()))))) < 1e-9
