import random

import numpy as np

from palisade.llm import nearcopies as n


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if words[i] == words[j] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    groups = {}
    for i, g in enumerate(label):
        groups.setdefault(g, []).append(rows[i][0])
    return sorted(min((k for k in ks if k is not None), default=None) if any(k is not None for k in ks) else None for ks in groups.values() if any(k is not None for k in ks))


def data():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, at = [], 0
    shared = " ".join(word() for _ in range(60))
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 8, 80, 300]))]
        for edits in [0, *[rng.choice([0, 1, 2, 3, 6, 12])] * rng.randrange(4)]:
            own = base[:]
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            rows.append((at, " ".join(own)))
            at += 1
        rows.append((at, " ".join(base[:50]) + " x " + shared + " " + " ".join(word() for _ in range(50))))
        at += 1
    rng.shuffle(rows)
    return [*rows, (9001, None), (9000, ""), (9002, " \n"), (9003, "one two"), (9004, "One  TWO"), (9004, "One  TWO")]


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = data()
    spark.createDataFrame([(k, t, "r") for k, t in rows], "doc_id long, text string, row string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for longest, held, broadcast in ((n.LONGEST, n.HELD, n.MOST_BROADCAST), (3, n.HELD, 0), (n.LONGEST, 2000, 10)):
        monkeypatch.setattr(n, "LONGEST", longest)
        monkeypatch.setattr(n, "HELD", held)
        monkeypatch.setattr(n, "MOST_BROADCAST", broadcast)
        out = n.without_copies(docs)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_rows_mean_the_same_whatever_the_split(spark, tmp_path, monkeypatch):
    """A table whose files are split otherwise at each reading."""
    rows = [(k, t) for k, t in data() if k is not None]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "d"))
    at, written = iter(range(1, 1000)), n.common.Scratch.written

    def otherwise(self, df):
        spark.conf.set("spark.sql.files.minPartitionNum", next(at) % 7 + 1)
        return written(self, df)

    monkeypatch.setattr(n.common.Scratch, "written", otherwise)
    out = n.without_copies(spark.read.parquet(str(tmp_path / "d")))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 30, 33, 60, 64, 100, 700):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[: size - size // 5 or 1]), np.unique(np.r_[base, rng.integers(0, 2**63, size // 6, dtype=np.uint64)])]
    for group in (sets[:12], sets):  # few are compared as numbers, many as arrays
        sizes, bits = np.array([len(s) for s in group]), [n.sketch(s) for s in group]
        own = n.Sketches(sizes, bits)
        for x in range(len(group)):
            left = np.array([y for y in range(len(group)) if y != x])
            near = {y for y in left.tolist() if min(sizes[x], sizes[y]) >= 0.8 * max(sizes[x], sizes[y])}
            who, differ = own.apart(x, np.array(sorted(near), dtype=np.int64))
            assert set(who.tolist()) == near
            for y, d in zip(who.tolist(), differ.tolist(), strict=True):
                short = min(len(bits[x]), len(bits[y])) * 8
                assert d == (n.folded(int.from_bytes(bits[x], "little"), len(bits[x]) * 8, short) ^ n.folded(int.from_bytes(bits[y], "little"), len(bits[y]) * 8, short)).bit_count()
                assert d <= len(np.setxor1d(group[x], group[y]))


def test_bands_catch_pairs():
    rng = np.random.default_rng(1)
    caught = 0
    for _ in range(400):
        a = rng.integers(0, 2**63, 450, dtype=np.uint64)
        b = np.r_[a[:400], rng.integers(0, 2**63, 50, dtype=np.uint64)]  # similarity 0.8
        caught += bool(set(n.bands(a)) & set(n.bands(b)))
    assert caught >= 396


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert n.without_copies(spark.read.parquet(str(tmp_path / "e"))).collect() == []


def test_pairs_that_share_no_band(spark, tmp_path):
    """Of a similarity over 0.8, with no band and no fingerprint group in common."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    while len(rows) < 6:
        own = [word() for _ in range(50)]
        other = own[:25] + [word()] + own[26:]
        a, b = (n.shingle_hashes(" ".join(w).encode()) for w in (own, other))
        apart = bin((n.simhash.majority(a) ^ n.simhash.majority(b)) & (2**64 - 1)).count("1")
        if apart > 2 and not set(n.bands(a)) & set(n.bands(b)):
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(other))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "p"))
    out = n.without_copies(spark.read.parquet(str(tmp_path / "p")))
    assert brute(rows) == [0, 2, 4] and sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
