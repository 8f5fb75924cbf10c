"""Source trees: listing in rounds, packing by bytes, and the stream."""

from pyspark.sql import functions as F

from palisade.sources import files as sources
from palisade.sources import trees
from palisade.streaming import text as streaming


def test_one_directory_of_10000_files(spark, tmp_path):
    top = tmp_path / "r" / "one" / "flat"
    top.mkdir(parents=True)
    for i in range(10_000):
        (top / f"{i}.py").write_text("x" * (5000 if i % 100 == 0 else i % 50))
    df = sources.read_source_files(spark, str(tmp_path / "r"), 8)
    own = df.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("content") + trees.OPEN_BYTES).alias("bytes"), F.count("*").alias("n")).collect()
    assert len(own) == 8 and sum(r.n for r in own) == 10_000
    mean = sum(r.bytes for r in own) / 8
    assert all(r.bytes < 2 * mean for r in own)


def test_rounds_deal_deep_trees_out_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "LISTED", 3)
    want = set()
    for repo in ("a", "b"):
        for d in ("", "x", "x/y", "x/y/z", "w/v/u", ".hid", "node_modules/q", "x/dist"):
            (tmp_path / "r" / repo / d).mkdir(parents=True, exist_ok=True)
            (tmp_path / "r" / repo / d / "_f.py").write_text(d)
            if d not in ("node_modules/q", "x/dist"):
                want.add((repo, f"{d}/_f.py".lstrip("/"), d))
    (tmp_path / "r" / "stray.py").write_text("no repository's")
    (tmp_path / "r" / "a" / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "r" / "a" / "loop").symlink_to(tmp_path / "r")
    got = sources.read_source_files(spark, str(tmp_path / "r")).collect()
    assert {(r.repo, r.path, r.content) for r in got} == want and len(got) == len(want)
    (tmp_path / "none").mkdir()
    assert sources.read_source_files(spark, str(tmp_path / "none")).collect() == []


def test_two_runs_of_a_stream_read_each_file_once(spark, tmp_path):
    root = tmp_path / "r"
    (root / "one" / "sub").mkdir(parents=True)

    def put(*names):
        for n in names:
            (root / "one" / n).write_text(f"mail {n}@x.org")

    def run():
        streaming.secure_tree(spark, str(root), str(tmp_path / "out"), str(tmp_path / "check"), 3).awaitTermination(120)
        return sorted((r.path, r.redacted) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a.py", "sub/b.py", ".env")
    first = run()
    assert [p for p, _ in first] == [".env", "a.py", "sub/b.py"] and all("EMAIL" in t for _, t in first)
    put("c.py", "sub/d.py")
    assert [p for p, _ in run()] == [".env", "a.py", "c.py", "sub/b.py", "sub/d.py"]
    batch = streaming.secured(sources.read_source_files(spark, str(root)), "content")
    assert run() == sorted((r.path, r.redacted) for r in batch.collect())
