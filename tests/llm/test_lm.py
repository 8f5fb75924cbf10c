import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import lm
from palisade.llm.common import fold


def corpus(n=500):
    rng = random.Random(3)
    tongues = [[f"{p}{rng.choice('aeiou')}{rng.choice('lmnr')}{i % 40}" for i in range(200)] for p in ("th", "ch", "qu")]
    docs = []
    for i in range(n):
        words = rng.choice(tongues)
        docs.append((i, " ".join(words[min(int(rng.expovariate(0.05)), 199)] for _ in range(rng.randrange(1, 120)))))
    return [*docs, (n, None), (n + 1, ""), (n + 1, ""), (n + 2, "NEW É words\x1fhere\n"), (None, "tha l")]


def low(t):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({i: " " for i in range(9, 14)}).split(" "), None]


@pytest.mark.parametrize("head", [lm.HEAD, 50])
def test_base_and_gain(spark, head):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").withColumn("held", fold() == 1)
    held = {r.doc_id for r in df.filter("held").collect()}
    count = Counter(w for k, t in docs if k not in held for w in low(t) if w != "")
    total, distinct = sum(count.values()), len(count)
    rows = lm.score(df.drop("held"), training=fold() != 1, head=head).collect()
    assert len(rows) == len(docs)
    want = Counter()
    for k, t in docs:
        own = [w for w in low(t) if w != ""]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        want[(k, len(own), sum(count[w] > 0 for w in own), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    if head == lm.HEAD:
        assert sum(r.score for r in rows if r.doc_id in held) > sum(r.base_score for r in rows if r.doc_id in held)


def test_model_sums_to_one(spark):
    docs = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string").select(F.col("text").cast("binary").alias("text"), F.lit(0).alias("part"))
    words = lm.known_words(lm.counted(df))
    a, b = lm.train(df, words, rounds=1)
    rng = np.random.default_rng(0)
    pairs, place = lm.buckets(words.total), np.array([3])
    for _ in range(5):
        context = np.r_[rng.integers(0, lm.SYMBOLS, 3), 0]
        total = sum(math.exp(lm.scores(a, b, np.array([0, 0, 0, s]), context, place)[0]) for s in range(lm.MODELLED + lm.TAILS))
        classes = np.exp(lm.log_softmax(a, lm.rows(context, place, pairs)))[0]
        inner = [np.exp(lm.log_softmax(b, lm.inner_rows(context, place, np.array([g]), pairs)))[0].sum() for g in range(lm.CLASSES)]
        assert abs(classes.sum() - 1) < 1e-4 and np.allclose(inner, 1, atol=1e-4) and abs(total - 1) < 1e-3
    for k in range(lm.TAILS):
        rest = [c for w, c in zip(words.rank, words.count, strict=True) if words.rank[w] >= lm.MODELLED and lm.tail(w) == k]
        assert abs(10 ** words.inside[k] - (sum(rest) + 0.5 * (len(rest) + 1))) < 1e-6


def test_step_equals_gradient_of_one_token_at_a_time():
    rng = np.random.default_rng(2)
    table = rng.normal(size=(40, 7)).astype(np.float32)
    at, target = rng.integers(0, 40, (3, 50)), rng.integers(0, 7, 50)
    at[0] = 0
    steps = lm.Steps(np.zeros((2 + 3 * lm.SYMBOLS, 1)), np.zeros((1, 1)))
    steps.tables[0], steps.squares[0] = table.copy(), np.full(table.shape, 1e-4, dtype=np.float32)
    steps.step(0, at, target)
    total = np.zeros(table.shape)
    for i, t in enumerate(target):
        z = table[at[:, i]].sum(axis=0)
        g = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        g[t] -= 1
        for r in at[:, i]:
            total[r] += g / len(target)
    assert np.allclose(steps.tables[0], table - lm.STEP * total / np.sqrt(1e-4 + total**2), atol=1e-4)


def test_rows_are_summed_by_number():
    rng = np.random.default_rng(5)
    for n, high in ((1, 1), (7, 2), (500, 3), (900, 400), (900, 100_000), (2 * lm.PIECE, 1)):
        values, rows = rng.normal(size=(n, 6)).astype(np.float32), np.minimum(rng.integers(0, high, (3, n)), rng.integers(0, high, (3, n)))
        want = np.zeros((high, 6))
        for r in rows:
            np.add.at(want, r, values)
        met, total = lm.summed(values, rows)
        assert sorted(met.tolist()) == np.unique(rows).tolist() and np.allclose(total, want[met], atol=1e-3)


def test_shares_beyond_the_range_of_float32():
    rng = np.random.default_rng(6)
    table, at, target = rng.normal(size=(60, 9)).astype(np.float32), rng.integers(0, 60, (3, 80)), rng.integers(0, 9, 80)
    table[::7] += 300
    table[::11] -= 300
    table[::13, 0] -= 500
    z = table[at].sum(axis=0).astype(np.float64)
    z -= z.max(axis=1, keepdims=True)
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(lm.log_softmax(table, at), want, atol=1e-3)
    assert np.allclose(lm.log_shares(table, at, target), want[np.arange(80), target], atol=1e-3)


def test_step_takes_less_time_than_sums_by_column():
    rng = np.random.default_rng(7)
    steps = lm.Steps(np.zeros((1 + 3 * lm.SYMBOLS + lm.PAIRS[0], 40), dtype=np.float32), np.zeros((1, 1), dtype=np.float32))
    at = np.minimum(rng.zipf(1.3, (5, lm.BATCH)), 2000) + 2000 * np.arange(5)[:, None]
    at[0] = 0
    target, g = rng.integers(0, 40, lm.BATCH), rng.normal(size=(40, lm.BATCH))

    def by_column():
        for c in g:
            sum(np.bincount(r, c, len(steps.tables[0])) for r in at)

    def least(f):
        times = []
        for _ in range(7):
            begun = time.process_time()
            f()
            times.append(time.process_time() - begun)
        return min(times)

    assert least(lambda: steps.step(0, at, target)) < least(by_column)


def test_head_has_the_most_frequent_tokens(spark):
    rows = [(f"w{i}".encode(), 1 + 3000 // (i + 1)) for i in range(500)]
    counts = spark.createDataFrame(rows, "token binary, n long")
    for head in (0, 1, 7, 60, 500, 1000):
        w = lm.known_words(counts, head)
        assert len(w.rank) <= head and (head < 500 or len(w.rank) == 500) and (head != 60 or len(w.rank) > 40)
        assert list(w.rank) == [t for t, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[: len(w.rank)]]


def test_buckets_grow():
    assert [lm.buckets(n) for n in (0, 10**6, 10**8, 10**12)] == [8192, 8192, 16384, 32768]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score(df, training=F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm.score(df.limit(0)).collect() == []
