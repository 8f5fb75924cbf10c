"""Document fingerprints by order MinHash, whose likeness follows edit distance.

Every run of ``K`` code points is numbered by how often it stood before in the text, so that repeats count apart.
The numbered runs are hashed; the leading bits of a second hash deal them into ``BINS`` bins, and in each bin the
``L`` least are selected, put back into the order in which they stand in the text, and hashed as a tuple. A
fingerprint has the bins' tuples (32 bits each, as hex digits; dashes where a bin is empty). One pass over
the text makes all of them, in place of a permutation for each.

Likeness of two fingerprints: the share of equal bins among those that are not empty in both; 1 where both are
empty and the texts are equal, else 0. Texts of fewer than ``K`` code points are one run. Whole texts are taken.
Null texts are as empty ones. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common

K, L, BINS = 10, 2, 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EMPTY = "-" * 8
#: Bytes of text in a range of keys: some seconds of one core. There are MOST_RANGES at most, as the driver holds a bound for each.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def signature(code: np.ndarray) -> np.ndarray:
    """The bins' tuple hashes, 0 for an empty bin."""
    out = np.zeros(BINS, dtype=np.uint64)
    if not len(code):
        return out
    n = max(1, len(code) - K + 1)
    run = np.zeros(n, dtype=np.uint64)
    for j in range(min(K, len(code))):
        run = run * _M1 + code[j : j + n]
    run = _mix(run)
    # How often each run stood before: equal runs are neighbours in order of hash and place.
    room = np.uint64(max(1, int(n - 1).bit_length()))
    packed = np.sort((run >> room << room) | np.arange(n, dtype=np.uint64))
    place = (packed & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    kind = packed >> room
    index = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, kind[1:] != kind[:-1]], index, 0))
    numbered = _mix(run[place] + _M2 * (index - first).astype(np.uint64))
    bins = (numbered >> np.uint64(58)).astype(np.int64)
    # Far more numbered runs than can be selected: keep the least of all first, if every bin has enough among them.
    if n > 64 * L * BINS:
        low = numbered << np.uint64(6)
        few = np.flatnonzero(low < np.uint64(int(2**64 * (16 * L * BINS / n))))
        if np.bincount(bins[few], minlength=BINS).min() >= L:
            numbered, bins, place = numbered[few], bins[few], place[few]
    order = np.argsort(numbered, kind="stable")  # by bin, then by hash
    numbered, bins, place = numbered[order], bins[order], place[order]
    start = np.searchsorted(bins, np.arange(BINS))
    count = np.minimum(np.diff(np.r_[start, len(bins)]), L)
    for size in range(1, L + 1):
        own = np.flatnonzero(count == size)
        if len(own):
            at = start[own][:, None] + np.arange(size)
            chosen = np.take_along_axis(numbered[at], np.argsort(place[at], axis=1), axis=1)
            got = np.zeros(len(own), dtype=np.uint64)
            for j in range(size):
                got = _mix(got * _M1 + chosen[:, j])
            out[own] = (got >> np.uint64(32)) | np.uint64(1)
    return out


def shown(sig: np.ndarray) -> str:
    return "".join(f"{x:08x}" if x else EMPTY for x in sig.tolist())


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    used = (a != 0) | (b != 0)
    return float((a[used] == b[used]).mean()) if used.any() else float(equal)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of a text column."""
    kept = [f.name for f in df.schema.fields if f.name != out]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(out)).schema
    inner = "__text"
    while inner in df.columns:
        inner += "_"

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, batch.num_columns - 1):
                got = [shown(signature(points(t))) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.string())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(inner)).mapInArrow(run, schema)


def in_order(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """(range, after, key, none, text): ranges of keys in ascending order, each with the next range's first row behind it.

    The keys alone are looked at for the ranges' bounds (as many numbers as ranges) and their first keys; the texts
    are dealt once. Behind the last range stands the first row of all. Rows of one key stay in one range, ordered
    by text; null keys come first.
    """
    least = -(1 << 63)
    place = F.coalesce(F.col(key).cast("long"), F.lit(least))
    bounds = docs.agg(F.percentile_approx(place, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b")).first().b if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    keyed = docs.select(place.alias("key"), F.col(text).alias("text"), F.col(key).isNull().alias("none")).withColumn("range", _range_of(F.col("key"), bounds))
    firsts = keyed.groupBy("range").agg(F.min("key").alias("first")).orderBy("range").collect()  # a row for each range
    own, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, r in enumerate(firsts):
        own[r.range], before[r.range] = r.first, firsts[i - 1].range
    to = F.when(F.get(_fixed(own, "bigint"), F.col("range")) == F.col("key"), F.get(_fixed(before, "int"), F.col("range")))
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("after"))
    there = F.when(to.isNotNull(), F.struct(to.alias("range"), F.lit(1).alias("after")))
    return keyed.select("key", "none", "text", F.explode(F.array_compact(F.array(here, there))).alias("r")).select("r.range", "r.after", "key", "none", "text")


def _fixed(values: list, kind: str):
    """A constant array, given to Spark as one literal whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(key, bounds: list[int]):
    """How many bounds lie at or below a key, in two steps over about the root of their number each."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads, nested = _fixed([c[0] for c in chunks], "bigint"), _fixed(chunks, "array<bigint>")
    at = F.size(F.filter(heads, lambda h: h <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(F.get(nested, at - 1), lambda h: h <= key)))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """A row for each document: fingerprints of its text and of its edited text, and their likeness.

    Edited: the last floor(n/4) code points give way to the first as many of the next document's text (or all of it),
    by ascending key; the last document's next is the first. A single document is its own next. Keys are whole numbers of 64 bits
    at most; others are refused, as ascending order of their texts would be another one.

    A range of keys is one partition. Ranges grow with the bytes of text, and are no fewer than the session's shuffle partitions.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key}: keys have to be whole numbers")
    common.small_batches(docs.sparkSession)
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(MOST_RANGES, -(-size // RANGE_BYTES)), 1)
    ordered = in_order(docs, key, text, ranges).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "after", "key", "text")
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for part in common.steps(batch, 4):
                for range_, after, key_, none, text_ in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    if after and (held is None or held[1]):
                        continue  # more rows of the next range's first key: the first of them has been taken
                    text_ = text_ or ""
                    code = points(text_)
                    sig = signature(code)
                    if held and not held[1]:
                        rows.append(compared(held[2:], text_, sig))
                    held = (range_, after, None if none else key_, text_, code, sig)
                if len(rows) >= 500:
                    yield flat(rows)
                    rows = []
        yield flat(rows)

    def compared(held, text_, sig):
        key_, own, code, mine = held
        n = len(code) // 4
        new = own[: len(code) - n] + text_[:n]
        changed = signature(points(new)) if n else mine
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return key_, len(code), digest, shown(mine), shown(changed), likeness(mine, changed, own == new), likeness(mine, sig, own == text_)

    def flat(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("range", "after", "key", "none", "text").mapInArrow(run, schema).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
