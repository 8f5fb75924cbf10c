"""Quality by hierarchical empirical Bayes: evidence of the document, its host and its path on the host.

A logistic classifier over binned surface features (shares of signs, capitals, digits, repeated words and lines, and the like)
gives each document's probability. Grouped aggregation sums the evidence of every path and host: a training row's label, else
the classifier's probability. A host's posterior mean is shrunk toward the global mean, a path's toward its host's, each
by a strength that the spread among hosts, or among paths around their hosts, gives by the method of moments; a sparse site stays close to what is above it.
A document's score adds, in log-odds, its own evidence and its path's posterior against the global mean; in that posterior, and
in its host's, the document itself is left out, so that nothing counts twice and no label meets its own row.

Training alone is bounded: the features of about ``LABELLED`` labelled rows, drawn by hash. All else covers all rows, and only
sums are shuffled, with one row of numbers a document. Null texts are as empty ones, very long ones are measured whole; null hosts and
paths are sites of their own; a site's only row has the posterior of the level above; without both labels among the training rows
the classifier gives the labels' share. Of several labels of a key the greatest counts. Repeated rows are each scored; an empty table gives no rows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .nearcopies import salted

LABELLED, BINS = 20_000, 16
_KINDS = [np.frombuffer(s, dtype=np.uint8) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!", b"#$%&*@^~", b".,;:?'\"()-", b" \n\t\r")]


def features(text: bytes | None) -> list[float]:
    """Surface features of a whole text in UTF-8."""
    raw = text or b""
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    own, lines = raw.split(), raw.split(b"\n")
    words = max(len(own), 1)
    return [
        float(np.log1p(len(raw))),
        *(float(counts[k].sum()) / n for k in _KINDS),
        len(raw) / words,
        len(set(own)) / words,
        sum(map(eq, own, own[1:])) / words,
        len(set(lines)) / len(lines),
    ]


class Classifier:
    """A logistic model with a weight for each bin of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5
        self.share = min(max(self.share, 1e-3), 1 - 1e-3)
        self.weights = None
        if len(set(y.tolist())) < 2:
            return
        self.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        at = self.bins(x)
        size = len(self.cuts) * BINS
        w, bias = np.zeros(size), float(np.log(self.share / (1 - self.share)))
        one = np.zeros((len(x), size + 1))
        one[np.arange(len(x))[:, None], at] = 1
        one[:, -1] = 1
        both = np.r_[w, bias]
        ridge = np.r_[np.full(size, 1.0), 0.0]
        for _ in range(12):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(one @ both, -30, 30)))
            g = one.T @ (p - y) + ridge * both
            h = (one * (p * (1 - p) + 1e-6)[:, None]).T @ one + np.diag(ridge + 1e-9)
            both = both - np.linalg.solve(h, g)
        self.weights = both

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") + i * BINS for i, (c, v) in enumerate(zip(self.cuts, x.T, strict=True))], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), np.log(self.share / (1 - self.share)))
        return np.clip(self.weights[self.bins(x)].sum(axis=1) + self.weights[-1], -12, 12)


def measured(docs: DataFrame) -> DataFrame:
    """(key, …, x): surface features in place of the last column, a binary ``text``."""

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, batch.num_columns - 1):
                got = [features(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "x"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, marks: DataFrame, labelled: int = LABELLED) -> Classifier:
    """docs: (key, text); marks: (key, y). About ``labelled`` rows' features come to the driver."""
    n = marks.count()
    drawn = marks.filter(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(14)), F.lit(1_000_003)) < F.lit(labelled / max(n, 1) * 1_000_003))
    rows = measured(docs.join(F.broadcast(drawn), "key").select("y", "text")).collect()
    rows = sorted((r.y, r.x) for r in rows)
    return Classifier(np.array([x for _, x in rows], dtype=float) if rows else np.zeros((0, len(features(None)))), np.array([y for y, _ in rows], dtype=float))


def _strength(mean, spread, weight):
    """How many rows the level above counts for, from the spread of means around it beyond that of their own sampling."""
    return F.when(spread > 0, F.greatest(F.least(mean * (1 - mean) * weight / spread - 1, F.lit(10_000.0)), F.lit(2.0))).otherwise(F.lit(10_000.0))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums by site, (host, path, n, s, hn, hs), and the global mean and the strengths of host and path, from (host, path, e)."""
    paths = common.written(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    top = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    both = salted(paths.withColumn("row", F.xxhash64("host", "path")).withColumn("site", F.coalesce("host", F.lit("\u0000"))), hosts.select(F.coalesce("host", F.lit("\u0000")).alias("site"), "hn", "hs"), "site")
    sums = both.select("host", "path", "n", "s", "hn", "hs")
    if not top.n:
        return sums, {"mean": 0.5, "host": 10_000.0, "path": 10_000.0}
    mean = min(max(top.s / top.n, 1e-3), 1 - 1e-3)
    # The spread of means around those above, less what sampling alone gives, over sites by their rows.
    beyond = lambda a, b, n: F.sum(n * ((a - b) ** 2 - b * (1 - b) / n)) / F.sum(n)
    host = hosts.agg(_strength(F.lit(mean), beyond(F.col("hs") / F.col("hn"), F.lit(mean), F.col("hn")), F.lit(1.0))).first()[0]
    path = both.agg(_strength(F.lit(mean), beyond(F.col("s") / F.col("n"), _held((F.col("hs") + host * mean) / (F.col("hn") + host)), F.col("n")), F.lit(1.0))).first()[0]
    return sums, {"mean": mean, "host": host, "path": path}


def _held(share):
    return F.least(F.greatest(share, F.lit(1e-3)), F.lit(1 - 1e-3))


def shrunk(p: dict[str, float], own=0.0, rows: int = 0):
    """Posterior means of host and path from columns n, s, hn, hs, without so many rows of so much evidence."""
    host = (F.col("hs") - own + p["host"] * p["mean"]) / (F.col("hn") - rows + p["host"])
    return host, (F.col("s") - own + p["path"] * _held(host)) / (F.col("n") - rows + p["path"])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", training=None) -> DataFrame:
    """(key, host, path, document, host_mean, path_mean, score) of every row: probabilities of the label 1."""
    spark = docs.sparkSession
    common.small_batches(spark)
    training = F.lit(True) if training is None else training
    marks = labels.filter(training & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("y"))
    row = F.monotonically_increasing_id().alias("row")  # deals a hot site over tasks; nothing is joined on it
    own = docs.select(row, F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(train(own.select("key", "text"), marks))

    def judge(batches):
        for batch in batches:
            for part in common.steps(batch, 4):
                x = np.array([features(t) for t in part.column(4).to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.logit(x))], names=["row", "key", "host", "path", "z"])

    kind = docs.schema[key].dataType.simpleString()
    judged = common.written(own.mapInArrow(judge, f"row long, key {kind}, host string, path string, z double"))
    p = 1 / (1 + F.exp(-F.col("z")))
    judged = common.written(judged.join(marks, "key", "left").select("row", "key", "host", "path", "z", F.coalesce("y", p).alias("e")))
    sums, strengths = posteriors(judged)
    site = lambda: F.xxhash64(F.coalesce("host", F.lit("\u0000")), F.coalesce("path", F.lit("\u0000")))
    whole = salted(judged.withColumn("site", site()), sums.withColumn("site", site()).drop("host", "path"), "site")
    host_mean, path_mean = shrunk(strengths, F.col("e"), 1)
    logit = lambda c: F.log(c / (1 - c))
    z = F.col("z") + logit(_held(path_mean)) - logit(F.lit(strengths["mean"]))
    return whole.select(F.col("key").alias(key), "host", "path", p.alias("document"), host_mean.alias("host_mean"), path_mean.alias("path_mean"), (1 / (1 + F.exp(-z))).alias("score"))
