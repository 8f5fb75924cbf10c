import hashlib
import random
import re

from palisade.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, bench, n=10):
    items = [(i, WORD.findall(low(t))) for i, t in bench]
    out = []
    for k, t in docs:
        w, hit, its = WORD.findall(low(t)), set(), set()
        for i, b in items:
            size = min(n, len(b))
            wins = {tuple(b[j : j + size]) for j in range(len(b) - size + 1)} if b else set()
            for j in range(len(w) - size + 1) if b else ():
                if tuple(w[j : j + size]) in wins:
                    hit.update(range(j, j + size))
                    its.add(i)
        ids = sorted(str(i) for i in its)
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def data():
    rng = random.Random(3)
    vocab = ["the", "of", "Äpfel", "x1", "b", "Ça", "2"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 9, 10, 14])))) for i in range(12)] + [(90, None), (91, ""), (92, "..!"), (93, bench0 := "one two three four five six seven eight nine ten eleven"), (94, bench0)]
    docs = [(i, ", ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "ONE two three-four five six seven eight nine TEN"), (103, f"zz {bench0} yy {bench0}"), (103, f"zz {bench0} yy {bench0}"), (None, bench0)]
    return docs, bench


def test_scan_equals_brute_force(spark):
    docs, bench = data()
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(brute(docs, bench), key=str)
    for chars in (d.BLOCK_CHARS, 100):
        got = sorted((tuple(r) for r in d.digests(d.scan(df, b, block_chars=chars)).collect()), key=str)
        assert got == want, chars


def test_removal(spark):
    docs, bench = data()
    df = spark.createDataFrame([(*r, "a") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    out = d.remove(df, b)
    assert out.columns == ["doc_id", "text", "item_id", "n_removed"] and out.count() == len(docs)
    rows = out.collect()
    assert not any(x[5] for x in brute([(r.doc_id, r.text) for r in rows], bench))
    clean = {k for k, *_, c in brute(docs, bench) if not c}
    texts = dict(docs)
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id in clean)


def test_removal_does_not_depend_on_blocks(spark):
    docs, bench = data()
    w = [f"w{i}" for i in range(1, 16)]
    bench = [*bench, *((200 + i, " ".join(w[i : i + 10])) for i in range(6))]
    docs = [*docs, (300, "a " + " ".join(w) + " b"), (301, " ".join([*w[:5], *w, *w[5:]]))]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    whole, dealt = (sorted((tuple(r) for r in d.remove(df, b, block_chars=c).collect()), key=str) for c in (d.BLOCK_CHARS, 100))
    assert dealt == whole and not any(x[5] for x in brute([r[:2] for r in dealt], bench))
    assert (300, "a  b", 15) in dealt


def test_nested_windows_of_two_blocks(spark):
    """Cutting one item's window makes the other's anew, nine deep; every number of blocks cuts to the end."""
    bench = [("x", "a b"), ("y", "c d")]
    docs = [(1, "s c a c a c a b d b d b d t"), (2, "s " + "a c " * 9 + "d b " * 9 + "t"), (3, "q")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    got = [{r.doc_id: (r.text.split(), r.n_removed) for r in d.remove(df, b, block_chars=c).collect()} for c in (100, 3, 1)]
    assert got[0] == got[1] == got[2] == {1: (["s", "t"], 12), 2: (["s", "t"], 36), 3: (["q"], 0)}
    scanned = [sorted(tuple(r) for r in d.digests(d.scan(df, b, block_chars=c)).collect()) for c in (100, 3, 1)]
    assert scanned[0] == scanned[1] == scanned[2] == sorted(brute(docs, bench))


def test_rows_mean_the_same_whatever_the_split(spark, tmp_path, monkeypatch):
    docs, bench = data()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "d"))
    at, written = iter(range(1, 1000)), d.common.written

    def otherwise(df):
        spark.conf.set("spark.sql.files.minPartitionNum", next(at) % 7 + 1)
        return written(df)

    monkeypatch.setattr(d.common, "written", otherwise)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((tuple(r) for r in d.digests(d.scan(spark.read.parquet(str(tmp_path / "d")), b, block_chars=100)).collect()), key=str)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == sorted(brute(docs, bench), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert d.scan(none, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in d.digests(d.scan(one, b)).collect()] == brute([(1, "a b")], [])
