import random

import numpy as np
import xxhash

from palisade.llm import simhash as s
from palisade.llm.components import components


def slow_fingerprint(t, k=3):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    ids = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in set(label)}
    return sorted(((rows[i][0], f"{fps[i]:016x}", ids[label[i]]) for i in range(len(rows))), key=str)


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)] + ["É", "the of"]
    rows = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 400]))]
        rows.append((i, " ".join(base)))
        for j in range(rng.randrange(3)):
            other = base[:]
            if len(other) > 5:
                other[rng.randrange(len(other))] = "new"
            rows.append((100 * (i + 1) + j, "\n".join(other).upper()))
    rows += [(5000, None), (4999, ""), (5001, " \t"), (5001, " \t"), (None, "w1 w2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in s.digests(s.groups(df)).collect()), key=str)
    assert got == slow_groups(rows)


def test_links_lose_none(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    fps = set(base.tolist())
    for x in base[:30].tolist():
        for _ in range(6):
            y = x
            for b in rng.integers(0, 64, 2):
                y ^= 1 << int(b)
            fps.add(int(np.uint64(y & (2**64 - 1)).view(np.int64)))
    fps |= {0, 1, 3, 7, -1}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(s.links(df)).collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    for x in fps:
        reach, stack = {x}, [x]
        while stack:
            y = stack.pop()
            new = {z for z in fps - reach if near(y, z)}
            reach |= new
            stack += new
        assert got.get(x, x) == min(reach)


def test_forest_of_many():
    fp = np.arange(3000, dtype=np.int64)
    edges = s.forest(fp, 2)
    assert len(edges) == 2999


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty(spark):
    assert s.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_parts_of_hot_classes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one text that many rows share word for word" if i % 3 else f"another text {i}") for i in range(300)] + [(7, "one text that many rows share word for word")] * 2 + [(None, None)] * 9, "doc_id long, text string")
    whole = sorted(map(str, s.groups(docs).collect()))
    monkeypatch.setattr(s, "LEAST_PART", 4)
    assert sorted(map(str, s.groups(docs).collect())) == whole and len(whole) == docs.count()
