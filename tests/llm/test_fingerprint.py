import hashlib
import random

import numpy as np
import pytest

from palisade.llm import fingerprint as f


def slow(text):
    """The bins' selected numbered runs, by the method's words."""
    code = f.points(text)
    if not len(code):
        return np.zeros(f.BINS, dtype=np.uint64)
    n = max(1, len(code) - f.K + 1)
    seen, entries = {}, []
    for i in range(n):
        run = np.zeros(1, dtype=np.uint64)
        for j in range(min(f.K, len(code))):
            run = run * f._M1 + code[i + j]
        key = tuple(code[i : i + f.K].tolist())
        seen[key] = seen.get(key, -1) + 1
        h = int(f._mix(f._mix(run) + f._M2 * np.array([seen[key]], dtype=np.uint64))[0])
        entries.append((h >> 58, h, i))
    out = np.zeros(f.BINS, dtype=np.uint64)
    for b in range(f.BINS):
        least = sorted(x for x in entries if x[0] == b)[: f.L]
        got = np.zeros(1, dtype=np.uint64)
        for _, h, _ in sorted(least, key=lambda x: x[2]):
            got = f._mix(got * f._M1 + np.array([h], dtype=np.uint64))
        if least:
            out[b] = (int(got[0]) >> 32) | 1
    return out


def test_signature_equals_brute_force():
    rng = random.Random(7)
    for n in (0, 1, 5, 9, 10, 11, 100, 700, 9000, 20000):
        t = "".join(rng.choice(["th", "an", "é", "\U0001f600", " "]) for _ in range(n))
        assert (f.signature(f.points(t)) == slow(t)).all(), n
    assert (f.signature(f.points("ab" * 9000)) == slow("ab" * 9000)).all()


def test_likeness_follows_edits():
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    near, far = t[:3900] + "x" * 100, t[:2000] + "".join(rng.choice("abcdefgh ") for _ in range(2000))
    a, b, c, d = (f.signature(f.points(x)) for x in (t, near, far, t[2000:] + t[:2000]))
    assert f.likeness(a, a, True) == 1 and f.likeness(a, b, False) > 0.8 > f.likeness(a, c, False) > 0
    assert f.likeness(a, d, False) < 0.9  # the same runs in another order


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 4
        new = t[: len(t) - n] + nxt[:n]
        out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), f.shown(f.signature(f.points(t))), f.shown(f.signature(f.points(new)))))
    return sorted(out, key=str)


def test_edited(spark):
    rng = random.Random(9)
    rows = [(i * 3, "".join(rng.choice("abc é") for _ in range(rng.randrange(90)))) for i in range(150)]
    rows += [(7, None), (8, ""), (9, "same"), (9, "same"), (9, "other one"), (None, "no key"), (10**12, "x" * 50000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, range string").repartition(5)
    for ranges in (1, 2, 9, 60):
        got = f.edited(df, ranges=ranges).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows), ranges
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "abc def ghi jkl")], "doc_id long, text string")
    assert [tuple(r)[:5] for r in f.edited(one).collect()] == want([(1, "abc def ghi jkl")])
    assert f.edited(one.limit(0)).collect() == []
    assert f.fingerprints(one).first().fingerprint == want([(1, "abc def ghi jkl")])[0][3]


def test_keys_that_are_no_whole_numbers(spark):
    with pytest.raises(TypeError):
        f.edited(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_ranges_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(f, "RANGE_BYTES", 1000)
    rows = [(i, chr(97 + i % 7) * (i % 300)) for i in range(400)]
    out = f.edited(spark.createDataFrame(rows, "doc_id int, text string"))
    assert out.rdd.getNumPartitions() == -(-sum(len(t) for _, t in rows) // 1000)
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == want(rows)
    assert out.schema["doc_id"].dataType.simpleString() == "int"


def test_negative_keys_and_the_least(spark):
    rows = [(-(1 << 63), "the least key"), (None, "no key"), (-5, "minus five"), ((1 << 63) - 1, "the greatest key"), (0, "zero")]
    got = f.edited(spark.createDataFrame(rows, "doc_id long, text string"), ranges=3).collect()
    assert len(got) == 5 and {r.doc_id for r in got} == {k for k, _ in rows}
