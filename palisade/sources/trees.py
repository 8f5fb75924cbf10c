"""Trees of source repositories as a table or a stream, hidden files included.

Spark's own file sources leave out names that start with a dot or an underscore, among them env and ignore files. The root has to be
mounted on the executors, each directory right below it is a repository. Skipped directories are pruned on the way. A file whose
bytes are no UTF-8 has a null content, and so has a link, which may point outside; links to directories are not followed. What cannot be read is left out.
"""

from __future__ import annotations

import datetime
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.paths import SKIP_DIRS
from .shared import written

SOURCE_FILES = "repo string, path string, file_name string, ext string, depth int, mtime timestamp, is_symlink boolean, content string"
#: Entries that a task lists before it hands the directories that are left to the next round.
LISTED = 20_000
#: Bytes of files that a task reads where no number of tasks is given.
TASK_BYTES = 64 << 20
#: Bytes of contents that are held at a time.
BATCH_BYTES = 8 << 20
#: What a file costs besides its bytes.
OPEN_BYTES = 4096


def _entries(root: str, repo: str | None, place: str) -> tuple[list[tuple], list[tuple]]:
    """The directories, (repo, place), and the files, (repo, path, size, mtime_ns, is_symlink), right in a directory; without a repo, of the root."""
    below, files = [], []
    try:
        entries = sorted(os.scandir(os.path.join(root, repo or "", place)), key=lambda e: e.name)
    except OSError:
        return below, files
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if repo is None:
                below.append((e.name, ""))
            elif e.name not in SKIP_DIRS:
                below.append((repo, f"{place}/{e.name}".lstrip("/")))
        elif repo is not None and os.path.isfile(e.path):
            try:
                said = os.stat(e.path)
            except OSError:
                continue
            files.append((repo, f"{place}/{e.name}".lstrip("/"), 0 if e.is_symlink() else said.st_size, said.st_mtime_ns, e.is_symlink()))
    return below, files


def _content(root: str, repo: str, path: str) -> str | None:
    with open(os.path.join(root, repo, path), "rb") as f:
        raw = f.read()
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _row(root: str, repo: str, path: str, mtime_ns: int, link: bool) -> tuple | None:
    """A row of SOURCE_FILES; None where the file has gone since it was listed."""
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    try:
        content = None if link else _content(root, repo, path)
    except OSError:
        return None
    changed = datetime.datetime.fromtimestamp(mtime_ns / 1e9, datetime.timezone.utc)
    return repo, path, name, ext if dot and stem else None, path.count("/") + 1, changed, link, content


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, size, mtime_ns, is_symlink) of every file, as a table in the shared folder.

    Directories are walked on the executors, in rounds: each task lists some ``LISTED`` entries below its own, and hands the directories that are left
    to the next round, where they are dealt out anew. The driver walks nothing; it goes on until no directory is left.
    """
    schema = "repo string, path string, size long, mtime_ns long, is_symlink boolean, is_dir boolean"

    def walk(batches):
        for batch in batches:
            left = deque(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            seen = 0
            while left and seen < LISTED:
                below, files = _entries(root, *left.popleft())
                left.extend(below)
                seen += len(below) + len(files) + 1
                yield from _batches([(*f, False) for f in files])
            yield from _batches([(repo, place, None, None, None, True) for repo, place in left])

    def _batches(rows):
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], names=["repo", "path", "size", "mtime_ns", "is_symlink", "is_dir"])

    frontier = spark.createDataFrame([(None, "")], "repo string, path string")
    found = None
    while True:
        listed = written(frontier.mapInArrow(walk, schema))
        files = listed.filter(~F.col("is_dir")).drop("is_dir")
        found = files if found is None else found.unionByName(files)
        frontier = listed.filter("is_dir").select("repo", "path")
        if frontier.isEmpty():
            return found
        frontier = frontier.repartition("repo", "path")


def packed(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``files`` (with a size) in partitions of about equal bytes: none has more than the mean and one file.

    Files stand on one line of bytes, which is cut evenly. Where each stands comes from sums within parts and the sums of parts before.
    """
    spark = files.sparkSession
    weight = F.col("size") + OPEN_BYTES
    count, total = files.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    tasks = max(1, min(count, tasks or max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))
    parts = 16 * max(1, -(-count // 1_000_000))
    dealt = files.withColumn("part", F.pmod(F.xxhash64("repo", "path"), F.lit(parts)))
    # One row a part: a million files or fewer each.
    before = dealt.groupBy("part").agg(F.sum(weight).alias("whole")).withColumn("before", F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).select("part", "before")
    place = F.sum(weight).over(Window.partitionBy("part").orderBy("repo", "path")) - weight
    own = dealt.withColumn("place", place).join(F.broadcast(before), "part")
    task = F.least(F.floor((F.col("before") + F.col("place")) * F.lit(tasks) / F.lit(max(1, total))), F.lit(tasks - 1)).cast("int")
    return own.withColumn("task", task).repartitionById(tasks, "task").drop("part", "place", "before", "task")


def read_source_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Every file of every repository below ``root``, in ``partitions`` tasks of about equal bytes (or as many as the bytes call for)."""

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        rows, held = [], 0
        for batch in batches:
            for listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = _row(root, *listed)
                if row is not None:
                    rows.append(row)
                    held += len(row[-1] or "")
                if held > BATCH_BYTES or len(rows) >= 5_000:
                    yield _table(rows, target)
                    rows, held = [], 0
        if rows:
            yield _table(rows, target)

    fields = spark.createDataFrame([], SOURCE_FILES).schema
    return packed(list_files(spark, root), partitions).select("repo", "path", "mtime_ns", "is_symlink").mapInArrow(read, fields)


def _table(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), target.types, strict=True)], schema=target)


class _Files(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class TreeStream(DataSource):
    """``spark.readStream.format("repo_tree_stream").load(root)``: the files of a tree, each once, later ones as they come.

    Offsets are (mtime in ns, repo, path) of the last file in that order; a batch has the files between two offsets, dealt into tasks by bytes. A file
    that is changed comes again. A file that comes with an older time than one already read is not seen: copy with new times. The
    stream's driver lists the tree at each trigger, as Spark's file streams do; use ``read_source_files`` for what is there at first.
    Option ``partitions``: tasks of a batch.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_tree_stream"

    def schema(self) -> str:
        return SOURCE_FILES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("partitions", "64")))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.tasks = root, partitions

    def _listed(self) -> Iterator[tuple]:
        left: deque = deque([(None, "")])
        while left:
            below, files = _entries(self.root, *left.popleft())
            left.extend(below)
            yield from files

    def initialOffset(self) -> dict:
        return {"mtime_ns": -1, "repo": "", "path": ""}

    def latestOffset(self) -> dict:
        last = max(((m, repo, path) for repo, path, _, m, _ in self._listed()), default=(-1, "", ""))
        return dict(zip(("mtime_ns", "repo", "path"), last, strict=True))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["mtime_ns"], o["repo"], o["path"]) for o in (start, end))
        new = sorted((f for f in self._listed() if low < (f[3], f[0], f[1]) <= high), key=lambda f: -f[2])
        n = max(1, min(self.tasks, len(new)))
        tasks: list[list[tuple]] = [[] for _ in range(n)]
        sums = [0] * n
        for repo, path, size, mtime_ns, link in new:
            i = sums.index(min(sums))
            tasks[i].append((repo, path, mtime_ns, link))
            sums[i] += size + OPEN_BYTES
        return [_Files(t) for t in tasks]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for listed in partition.files:
            row = _row(self.root, *listed)
            if row is not None:
                yield row

    def commit(self, end: dict) -> None:
        pass


def stream_source_files(spark: SparkSession, root: str, partitions: int = 64) -> DataFrame:
    spark.dataSource.register(TreeStream)
    return spark.readStream.format("repo_tree_stream").option("partitions", partitions).load(root)
