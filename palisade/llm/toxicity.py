"""Toxicity by non-negative positive-unlabelled learning.

Classifiers are trained on confirmed toxic texts (P) and on unlabelled texts (U) that hold toxic ones among them.
With the class prior p (the share of toxic among all labelled training rows, counted over all of them) the risk is

    p * E_P[l(+1)] + max(0, E_U[l(-1)] - p * E_P[l(-1)])

The second term estimates the risk on clean texts; where it falls below zero by more than the prior (which is itself an
estimate), the step goes against it, so that the classifier does not fit the sample's noise. l is the logistic loss and the scores
are linear in the presence of words and of word beginnings of 3 to 8 characters; long texts are scored whole.

Spark counts the features of the sample, chooses those whose share among P stands out from that among U, and deals
the sample, as numbers of chosen features, into ``MODELS`` parts; each trains one numpy classifier, and their
weights are averaged. Bounds, all of them parameters of training alone: about ``POSITIVES`` toxic and
``UNLABELLED`` unlabelled texts, drawn by hash of the key, and ``FEATURES`` features. Scoring covers every row.

Only training rows' labels are read. Null texts are as empty ones and get the bias's score; a null label is none;
several labels of a key: the greatest counts. Very long texts are scored whole; of features that stand out alike the first by name is
chosen; an empty table gives no rows. Without a toxic training row every score is 0. Repeated rows get
the same score, and other columns pass through ``score`` (new columns replace those of the same name).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

POSITIVES, UNLABELLED, FEATURES, MODELS = 6_000, 18_000, 4_096, 4
#: Least estimated share of toxic texts among those with a feature; below it a feature tells little and adds up to noise in long texts.
PURITY = 0.45
#: Standard errors by which the share of a feature among P has to lie above that among U; there are a great many features.
STANDS_OUT = 3.5
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> set[str]:
    """The words of a text and, marked by a sign before them, their beginnings."""
    own = set(_WORD.findall(text.lower())) if text else set()
    return own | {f"{n}{w[:n]}" for w in own for n in range(3, 9) if len(w) > n}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sample:
    """Texts of both sides as numbers of features, for the risk of some weights."""

    def __init__(self, p: list[list[int]], u: list[list[int]], size: int, prior: float):
        self.sizes, self.size, self.prior = (len(p), len(u)), size, prior
        self.rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (p, u)]
        self.columns = [np.array([i for s in x for i in s], dtype=np.int64) for x in (p, u)]

    def judged(self, w: np.ndarray, bias: float) -> list[np.ndarray]:
        """The probability of toxic of each text, by side."""
        return [_sigmoid(np.bincount(r, w[c], n) + bias) for r, c, n in zip(self.rows, self.columns, self.sizes, strict=True)]

    def clean_risk(self, zp: np.ndarray, zu: np.ndarray) -> float:
        """E_U[l(-1)] - p * E_P[l(-1)]"""
        loss = lambda z: -np.log1p(-np.minimum(z, 1 - 1e-12)).mean()
        return loss(zu) - self.prior * loss(zp)

    def gradient(self, w: np.ndarray, bias: float) -> np.ndarray:
        """Of the weights, then of the bias: of the whole risk, or against its second term where that is too far below zero."""
        zp, zu = self.judged(w, bias)
        wp, wu = self.prior / self.sizes[0], 1 / self.sizes[1]
        if self.clean_risk(zp, zu) >= -self.prior:
            g = [-wp * (1 - zp) - wp * zp, wu * zu]
        else:
            g = [wp * zp, -wu * zu]
        return np.r_[sum(np.bincount(c, x[r], self.size) for c, x, r in zip(self.columns, g, self.rows, strict=True)), sum(x.sum() for x in g)]


def weigh(p: list[list[int]], u: list[list[int]], size: int, prior: float) -> np.ndarray:
    """Weights of the features 0 to size - 1, then the bias, from texts given as numbers of features."""
    sample, w, bias = Sample(p, u, size, prior), np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, 401):
        g = sample.gradient(w, bias) + np.r_[1e-4 * w, 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return np.r_[w, bias]


def _drawn(key: str, salt: int, share: float):
    """Whether a key belongs to a share of all keys, by its hash."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1_000_003)) < F.lit(share * 1_000_003)


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, in_p, in_u): in how many texts of either side each feature occurs."""

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in common.steps(batch, 1):
                for side, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts.update((side, x) for x in features(t))
                    if len(counts) > 200_000:
                        yield flat(counts)
                        counts.clear()
        yield flat(counts)

    def flat(counts):
        sides, names = [s for s, _ in counts], [x for _, x in counts]
        n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        toxic = np.array(sides, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n * toxic), pa.array(n * (1 - toxic))], names=["feature", "in_p", "in_u"])

    return sample.select("side", "text").mapInArrow(count, "feature string, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", training=None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, size: int = FEATURES, models: int = MODELS) -> dict[str, float] | None:
    """Averaged weights of the features, and the bias under the empty name; None without a toxic training row.

    training: a condition on the key of rows whose labels and texts may be learnt from (all by default).
    """
    common.small_batches(docs.sparkSession)
    spark, training = docs.sparkSession, F.lit(True) if training is None else training
    marks = labels.filter(training & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    total = docs.filter(training).count()
    if not toxic or not total:
        return None
    prior = min(toxic / n, 0.99)
    own = docs.filter(training).select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = marks.filter((F.col("y") == 1) & _drawn("key", 11, positives / toxic)).select("key")  # about ``positives`` keys, whatever the corpus
    p = own.join(F.broadcast(chosen), "key", "left_semi").withColumn("side", F.lit(1))
    u = own.filter(_drawn("key", 12, unlabelled / total)).withColumn("side", F.lit(0))
    sample = common.written(p.unionByName(u))  # bounded by the two numbers of texts
    sides = {r.side: r.n for r in sample.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if len(sides) < 2:
        return None
    a, b = (F.col("in_p") + 0.5) / (sides[1] + 1), (F.col("in_u") + 0.5) / (sides[0] + 1)
    # prior * a / b estimates the share of toxic texts among those that have the feature.
    z = (a - b) / F.sqrt(a * (1 - a) / sides[1] + b * (1 - b) / sides[0])
    names = [r.feature for r in _counted(sample).filter("in_p >= 3").withColumn("z", z).filter((F.col("z") > STANDS_OUT) & (prior * a / b >= PURITY)).orderBy(F.desc("z"), "feature").limit(size).collect()]
    at = spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})

    def numbered(batches):
        for batch in batches:
            for part in common.steps(batch, 2):
                got = [sorted(at.value[x] for x in at.value.keys() & features(t)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.list_(pa.int32()))], names=["model", "side", "own"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [sorted(list(x) for x in rows.own[rows.side == s]) for s in (1, 0)]
        if not sets[0] or not sets[1]:
            return pd.DataFrame({"weights": []})
        return pd.DataFrame({"weights": [weigh(*sets, len(names), prior)]})

    model = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(13)), F.lit(models)).cast("int").alias("model")
    dealt = sample.select(model, "side", "text").mapInArrow(numbered, "model int, side int, own array<int>")
    fitted = [r.weights for r in dealt.groupBy("model").applyInPandas(fit, "weights array<double>").collect()]  # one row a model
    if not fitted:
        return None
    return dict(zip([*names, ""], np.mean(fitted, axis=0).tolist(), strict=True))


def score(docs: DataFrame, weights: dict[str, float] | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic."""
    common.small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    inner = "__text"
    while inner in docs.columns:
        inner += "_"

    def run(batches):
        w = shared.value or {"": -np.inf}
        known = w.keys()
        bias = w[""]
        for batch in batches:
            for part in common.steps(batch, batch.num_columns - 1):
                z = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    z.append(bias + sum(sorted(w[x] for x in known & features(t))))
                with np.errstate(over="ignore"):
                    got = 1 / (1 + np.exp(-np.array(z, dtype=np.float64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias(inner)).mapInArrow(run, schema)
