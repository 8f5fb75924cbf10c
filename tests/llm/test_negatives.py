"""Hard negatives: exact products, and the whole operator against a brute-force version and its SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import negatives, registered


@pytest.mark.parametrize("size", [1, 300, 2**20, 2**31, 2**60, 2**136])
def test_scores_are_exact(size):
    rng = random.Random(size)
    a, b = ([[float(rng.randint(-size, size)) for _ in range(70)] for _ in range(n)] for n in (9, 13))
    got = negatives.scores(negatives.Residues(np.array(a)), negatives.Residues(np.array(b)))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            exact = sum(int(p) * int(q) for p, q in zip(x, y, strict=True))
            assert got[i, j] == max(-negatives.LIMIT, min(negatives.LIMIT, exact))


def test_scores_over_many_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-125, 126, (3, 5000)).astype(float), rng.integers(-125, 126, (4, 5000)).astype(float)
    a[0], b[0] = 125, 125
    assert (negatives.scores(negatives.Residues(a), negatives.Residues(b)) == (a @ b.T).astype(np.int64)).all()


def plain(rows):
    """The contract, row by row; ids may be null."""
    ok = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in ok]
    out = []
    for anchor in {(i, tuple(v), y) for i, v, y in ok if i is not None and i % 100 == 0}:
        scored = [(sum(p * q for p, q in zip(anchor[1], v, strict=False)), i, y) for i, v, y in ok if i != anchor[0]]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p in [s for s in scored if s[2] == anchor[2]][:5]:
            fit = [s for s in scored if s[2] != anchor[2] and 30 * p[0] <= 100 * s[0] <= 90 * p[0]][:10]
            out += [(anchor[0], p[1], rank, n[1], p[0], n[0]) for rank, n in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(rng, n, same=0):
    hot = [rng.gauss(0, 0.2) for _ in range(8)]
    return [(i, hot if i % 3 < same else [rng.gauss(0, 0.2) for _ in range(8)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("same", [0, 1])
@pytest.mark.parametrize("budget", [32 << 20, 200])
def test_equals_brute_force(spark, monkeypatch, same, budget):
    """With equal vectors in a third of the rows, and with anchors in one block and in many."""
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", budget)
    rng = random.Random(same)
    rows = vectors(rng, 700, same)
    rows[3:9] = [(3, None, 1), (4, [0.1] * 8, None), (5, [float("nan")] * 8, 1), (6, [None] + [0.1] * 7, 2), (7, [float("inf")] * 8, 1), (8, [], 1)]
    rows += [(None, [0.2] * 8, 1), (None, [0.2] * 8, 2), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]), (301, [0.1] * 3, 1), (201, [3e38] * 8, 0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int, anchor int").repartition(5)
    got = sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()), key=str)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    top = negatives.LIMIT
    want = [(a, p, r, n, max(-top, min(top, ps)), max(-top, min(top, ns))) for a, p, r, n, ps, ns in plain(single)]
    assert [g for g in got if abs(g[4]) < top] == [w for w in want if abs(w[4]) < top]
    assert len(got) > 100


def test_empty_tables_and_no_anchor(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(100, [1.0, 2.0], 3)], empty.schema)
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine(alone, F.col("vec_id") == 5).collect() == []


def test_query_equals_its_sql(spark, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = registered.op13_hard_negatives(spark, sf_dir)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registered.oracle_sql()['op13_hard_negatives']})").fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and want
