"""Benchmark decontamination: find and remove what documents share with benchmark items.

Both sides are lower-cased (A-Z) and cut into words of digits, ASCII letters and non-ASCII characters. A window is
``n`` consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside
any occurrence of a window is hit.

The windows are a hash set of word-id tuples, broadcast to the tasks, which scan every whole text. The set's size
is checked: a benchmark of more than ``block_chars`` characters is dealt into blocks of about that size by item. The documents
are then numbered once, written with their numbers and scanned once for each block, whose hits are written to the shared folder before
the next block is built, so that one block is held at a time; what the blocks find in a document is merged by a shuffle of the
spans and items of documents with hits, no texts. Word ids stand for whole words, so that a hit in the set is an exact match.

Nulls: a null text has no words; a null item id is an item all the same, listed as none. Empty texts have no words, very long
ones are scanned whole. Empty tables give no rows or no hits. Repeated rows are each judged by themselves, and so are documents of
one key; items of one id are one item. Columns besides those named pass through ``remove``, one of the name of its count excepted, which it replaces.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most characters of benchmark text whose windows are broadcast at once.
BLOCK_CHARS = 4_000_000
#: Lower-cases A-Z and makes every ASCII character that is no letter or digit a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a text that is not lower-cased.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


class Windows:
    """The windows of some items."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.items: dict[bytes, list] = {}
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if own:
                flat, size = np.array(own, dtype=np.int32), min(n, len(own))
                for i in range(len(own) - size + 1):
                    had = self.items.setdefault(flat[i : i + size].tobytes(), [])
                    if not had or had[-1] != item:  # an item's windows come together
                        had.append(item)
        self.sizes = sorted({len(k) // 4 for k in self.items})

    def hits(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words (from 0, end exclusive) and the items whose windows occur."""
        ids = np.fromiter(map(self.ids.get, own, repeat(0)), dtype=np.int32, count=len(own))
        unknown = np.r_[0, np.cumsum(ids == 0)]
        marks, found = np.zeros(len(own) + 1, dtype=np.int32), set()
        for size in self.sizes:
            if size <= len(own):
                for i in np.flatnonzero(unknown[size:] == unknown[:-size]).tolist():
                    if items := self.items.get(ids[i : i + size].tobytes()):
                        marks[i] += 1
                        marks[i + size] -= 1
                        found.update(items)
        if not found:
            return [], found
        inside = np.diff(np.r_[0, (np.cumsum(marks)[:-1] > 0).astype(np.int8), 0])
        return list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True)), found


def block_count(benchmark: DataFrame, text: str, block_chars: int) -> int:
    chars = benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    return max(1, -(-chars // block_chars))


def block(benchmark: DataFrame, i: int, k: int, n: int, item: str, text: str) -> Windows:
    """The windows of the i-th of k blocks of the benchmark."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.length("text") > 0)
    part = rows if k == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(k)) == i)
    return Windows([(r.item, r.text) for r in part.toLocalIterator()], n)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scan(docs: DataFrame, shared, key: str, text: str) -> DataFrame:
    """key, n_words, spans, items of every row, by a broadcast block of windows."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        w = shared.value
        for batch in batches:
            for part in common.steps(batch, 1):
                counts, spans, items = [], [], []
                for t in part.column(1).to_pylist():
                    own = words(t)
                    s, f = w.hits(own)
                    counts.append(len(own))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    items.append(sorted(x for x in f if x is not None))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its key, ``n_words``, merged ``spans`` of hit words and ``items`` (ids as strings, in order)."""
    common.small_batches(docs.sparkSession)
    k = block_count(benchmark, item_text, block_chars)
    if k == 1:
        shared = docs.sparkSession.sparkContext.broadcast(block(benchmark, 0, 1, n, item, item_text))
        return _scan(docs, shared, key, text).withColumnRenamed("key", key)
    rows = common.written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")))
    hits, counts = _merged(rows, benchmark, k, n, item, item_text)
    out = counts.join(hits, "row", "left").join(rows.select("row", "key"), "row")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(rows: DataFrame, benchmark: DataFrame, k: int, n: int, item: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(row, spans, items) of rows (row, text) with hits, from all blocks together, and (row, n_words) of all."""
    base = counts = None
    for i in range(k):
        shared = rows.sparkSession.sparkContext.broadcast(block(benchmark, i, k, n, item, item_text))
        own = _scan(rows, shared, "row", "text")
        own = common.written(own if i == 0 else own.filter(F.size("spans") > 0))
        shared.destroy()
        counts = own.select(F.col("key").alias("row"), "n_words") if i == 0 else counts
        base = own if base is None else base.unionByName(own)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    last = lambda x: F.element_at(x, -1)
    merge = lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))
    hits = (
        base.filter(F.size("spans") > 0)
        .groupBy(F.col("key").alias("row"))
        .agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("row", F.aggregate("spans", F.array().cast(SPANS), merge).alias("spans"), "items")
    )
    return hits, counts


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, removed: str = "n_removed") -> DataFrame:
    """``docs`` without the hit words and what stands between them; a column ``removed`` counts the words that went.

    Cutting a span joins what stood around it, which can make a window anew: cutting goes on until none occurs. With
    more than one block a round takes the hits of all blocks, cuts their union once, and goes on with the texts that it cut.
    """
    out = docs.drop(removed).withColumn(removed, F.lit(0).cast("long"))
    at, schema = out.columns.index(text), out.schema
    common.small_batches(docs.sparkSession)
    k = block_count(benchmark, item_text, block_chars)
    if k == 1:
        shared = docs.sparkSession.sparkContext.broadcast(block(benchmark, 0, 1, n, item, item_text))
        return out.mapInArrow(_remover(shared, at), schema)
    rows = common.written(out.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("own")))
    now, rounds = rows.select("row", F.col(f"own.`{text}`").alias("text"), F.lit(0).cast("long").alias("gone")), []
    while True:
        hits = _merged(now, benchmark, k, n, item, item_text)[0].select("row", "spans")
        now = common.written(now.join(hits, "row").select("row", "text", "gone", "spans").mapInArrow(_cutter, "row long, text string, gone long"))
        if now.isEmpty():
            break
        rounds.append(now.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return rows.select("own.*")
    changed = rounds[0]
    for r in rounds[1:]:
        changed = changed.unionByName(r)
    changed = changed.groupBy("row").agg(F.max_by(F.struct("text", "gone"), "round").alias("new"))
    new = {text: F.when(F.col("new").isNull(), F.col(f"own.`{text}`")).otherwise(F.col("new.text")), removed: F.coalesce("new.gone", F.lit(0).cast("long"))}
    return rows.join(changed, "row", "left").select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in out.columns])


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in WORD.finditer(text)]
    for a, b in reversed(spans):
        text = text[: places[a][0]] + text[places[b - 1][1] :]
    return text


def _cutter(batches):
    """Cuts rows (row, text, gone, spans) once."""
    for batch in batches:
        for part in common.steps(batch, 1):
            spans = [[(s["start"], s["end"]) for s in own] for own in part.column(3).to_pylist()]
            texts = [_without(t, s) for t, s in zip(part.column(1).to_pylist(), spans, strict=True)]
            gone = np.asarray(part.column(2)) + np.array([sum(b - a for a, b in s) for s in spans], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(gone)], names=["row", "text", "gone"])


def cut(text: str, windows: Windows) -> tuple[str, int]:
    gone = 0
    while True:
        spans, _ = windows.hits(words(text))
        if not spans:
            return text, gone
        text = _without(text, spans)
        gone += sum(b - a for a, b in spans)


def _remover(shared, at: int):
    def run(batches):
        w = shared.value
        for batch in batches:
            for part in common.steps(batch, at):
                got = [cut(t, w) if t else (t, 0) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in got], columns[at].type)
                columns[-1] = pa.array(np.asarray(columns[-1]) + np.array([g for _, g in got], dtype=np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return scanned.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL for the digests of whole documents and benchmark.
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
scanned AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM scanned JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
