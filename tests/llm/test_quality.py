import random

from pyspark.sql import functions as F

from palisade.llm import quality as q
from palisade.llm.common import fold


def corpus(n=1500):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        host = f"h{rng.randrange(8)}"
        good = rng.random() < (0.2 if host == "h0" else 0.9)
        plain = good if rng.random() < 0.9 else not good  # what the text shows is not always right
        words = [word() for _ in range(rng.randrange(5, 80))]
        docs.append((i, " ".join(words) if plain else " ".join(w + "###" for w in words), host, f"p{rng.randrange(3)}"))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_and_sites(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = q.score(df, marks, training=fold() != 0).join(marks, "doc_id").filter(fold() == 0).collect()
    right = lambda c: sum((r[c] >= 0.5) == bool(r.quality) for r in rows) / len(rows)
    assert right("score") >= 0.85 and right("score") >= right("document") - 0.02
    means = {r.host: r.host_mean for r in rows}
    assert means["h0"] < 0.5 < min(v for k, v in means.items() if k != "h0")


def test_sparse_sites_stay_near_the_mean(spark):
    rows = [("big", "a", 1.0)] * 200 + [("big", "b", 0.0)] * 200 + [("tiny", "a", 0.0)] + [(f"s{i}", "a", float(i % 2)) for i in range(40)]
    sums, strengths = q.posteriors(spark.createDataFrame(rows, "host string, path string, e double"))
    out = {(r.host, r.path): r for r in sums.select("host", "path", q.shrunk(strengths)[1].alias("path_mean")).collect()}
    assert 0.2 < out["tiny", "a"].path_mean < 0.5 and out["big", "a"].path_mean > 0.9 > 0.1 > out["big", "b"].path_mean


def test_posteriors_equal_plain_sums(spark):
    """Score, host and path means of every row, from sums over all other rows of its site in Python."""
    docs, labels = corpus(400)
    docs += [(5000, "x", "lone", "p"), (5001, "y", None, None), (5002, "z", None, "p0"), (5002, "z", None, "p0")]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    training = dict(marks.filter(fold() != 0).collect())
    rows = q.score(df, marks, training=fold() != 0).collect()
    e = [float(training[r.doc_id]) if r.doc_id in training else r.document for r in rows]
    mean = min(max(sum(e) / len(e), 1e-3), 1 - 1e-3)
    clip = lambda x: min(max(x, 1e-3), 1 - 1e-3)
    by = {}
    for r, x in zip(rows, e, strict=True):
        for site in ((r.host,), (r.host, r.path)):
            by.setdefault(site, []).append(x)

    def strength(sites):  # of (rows, mean, mean above)
        spread = sum(n * ((m - a) ** 2 - a * (1 - a) / n) for n, m, a in sites) / sum(n for n, _, _ in sites)
        return max(min(mean * (1 - mean) / spread - 1, 10_000), 2) if spread > 0 else 10_000

    kh = strength([(len(v), sum(v) / len(v), mean) for k, v in by.items() if len(k) == 1])
    above = {k[0]: (sum(v) + kh * mean) / (len(v) + kh) for k, v in by.items() if len(k) == 1}
    kp = strength([(len(v), sum(v) / len(v), clip(above[k[0]])) for k, v in by.items() if len(k) == 2])
    for r, x in zip(rows, e, strict=True):
        h, p = by[(r.host,)], by[(r.host, r.path)]
        host = (sum(h) - x + kh * mean) / (len(h) - 1 + kh)
        path = (sum(p) - x + kp * clip(host)) / (len(p) - 1 + kp)
        odds = r.document / (1 - r.document) * clip(path) / (1 - clip(path)) * (1 - mean) / mean
        assert abs(r.host_mean - host) < 1e-6 and abs(r.path_mean - path) < 1e-6 and abs(r.score - odds / (1 + odds)) < 1e-6
        if r.host == "lone":
            assert abs(r.host_mean - mean) < 1e-9


def test_odd_rows(spark):
    docs, labels = corpus(200)
    rows = [*docs, (None, None, None, None), (900, "", "h1", None), (900, "", "h1", None), (901, "x " * 50000, None, "p")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, score double")
    out = q.score(df, spark.createDataFrame([*labels, (None, 1), (900, None)], "doc_id long, quality int"))
    assert out.count() == 204 and out.filter("score is null or score < 0 or score > 1").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.score(df, none).count() == 204 and q.score(df.limit(0), none).collect() == []
