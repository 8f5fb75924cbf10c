"""SimHash fingerprints and the groups of documents whose fingerprints differ in few bits.

Fingerprint: texts are lower-cased (A-Z) and cut into words at ASCII white space; each run of ``k`` words, repeats
included and joined by spaces, is hashed by XXH64 (seed 42); a bit is 1 if over half of the hashes have it. A text
of fewer words is one run; one without words has fingerprint zero.

Links: the bits are cut into segments, and a fingerprint is mapped to the vector of its segments' bit counts. Two
fingerprints within Hamming distance 2 lie within Manhattan distance 2 there, so that some grid cell is at most one
step from both: each distinct fingerprint goes to its own cell and to those one step away, and cells are sorted
runs in which the exact distance is verified. A run gives the edges of a spanning forest, never all pairs; a walk
compares what it reaches with what is left, in numpy, whatever the run's length. Components follow by joins.

Copies never meet each other: only distinct fingerprints are searched, and documents join their fingerprint's
component at the end. Null texts are as empty ones; null ids count as documents and never as the least id of a
component; repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
SALTS = 16
#: A class of more rows than LEAST_PART and than a PARTS-th of all rows is dealt in parts of as many.
LEAST_PART, PARTS = 1024, 100_000


def runs(text: bytes | None, k: int) -> list[bytes]:
    """The runs of k words of a text in UTF-8."""
    own = (text or b"").lower().split()
    if len(own) <= k:
        return [b" ".join(own)] if own else []
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1
    starts = np.r_[0, np.cumsum(sizes)]
    flat = b" ".join(own)
    return [flat[a:b] for a, b in zip(starts[: len(own) - k + 1].tolist(), (starts[k:] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some unsigned 64-bit hashes have, as a signed number."""
    n, total = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, k: int = 3) -> int:
    digest = xxhash.xxh64_intdigest
    own = runs(text, k)
    return majority(np.fromiter([digest(r, SEED) for r in own], dtype=np.uint64, count=len(own))) if own else 0


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): each row's key and its fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, 1):
                got = [fingerprint(t, k) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int64())], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def cells(fp: np.ndarray, segments: int) -> np.ndarray:
    """(n, 1 + 2 * segments): the cell of each fingerprint, then those one step away; -1 where a count cannot go."""
    width = 64 // segments
    bits = np.uint64(width)
    mask = np.uint64((1 << width) - 1)
    room = width.bit_length()
    if room * segments > 63:
        raise ValueError("segments: too many for a cell number of 63 bits")
    counts = np.stack([np.bitwise_count((fp.view(np.uint64) >> (np.uint64(i) * bits)) & mask) for i in range(segments)], axis=1).astype(np.int64)
    step = np.int64(1) << (np.arange(segments, dtype=np.int64) * room)
    own = (counts * step).sum(axis=1, dtype=np.int64)
    return np.concatenate([own[:, None], np.where(counts < width, own[:, None] + step, -1), np.where(counts > 0, own[:, None] - step, -1)], axis=1)


def forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what a chain of steps of at most ``most`` bits connects."""
    rest, out = fp.view(np.uint64), []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                found = rest[near]
                a = int(np.uint64(x).view(np.int64))
                out += [(a, b) for b in found.view(np.int64).tolist()]
                stack.extend(found)
                rest = rest[~near]
    return out


def links(distinct: DataFrame, most: int = 2, segments: int = 16) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column ``fp``) that connect all within ``most`` (2 at most) bits."""
    if not 0 <= most <= 2:
        raise ValueError("most: cells one step from both sides reach 2 bits at most")

    def spread(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                grid = cells(part, segments)
                keep = grid.ravel() >= 0
                yield pa.RecordBatch.from_arrays([pa.array(grid.ravel()[keep]), pa.array(np.repeat(part, grid.shape[1])[keep])], names=["cell", "fp"])

    def search(batches):
        cell, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            cell, fp = np.r_[cell, np.asarray(batch.column(0))], np.r_[fp, np.asarray(batch.column(1))]
            if len(cell) and cell[0] != cell[-1]:
                whole = int(np.searchsorted(cell, cell[-1]))  # the last run may go on in the next batch
                yield found(cell[:whole], fp[:whole])
                cell, fp = cell[whole:], fp[whole:]
        yield found(cell, fp)

    def found(cell, fp):
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[starts, len(cell)])
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= most
        a, b = [fp[two][near]], [fp[two + 1][near]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if edges := forest(fp[s : s + n], most):
                both = np.array(edges, dtype=np.int64)
                a.append(both[:, 0])
                b.append(both[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(spread, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def groups(docs: DataFrame, k: int = 3, most: int = 2, segments: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): each row's fingerprint, and the least key that links lead to from it."""
    common.small_batches(docs.sparkSession)
    marked = common.written(fingerprints(docs, k, key, text))
    classes = common.written(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes, most, segments)).withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(roots.join(linked, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    # A class of many copies goes out once for each part of its rows. There are PARTS such classes at most, so they are broadcast.
    rows = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = max(LEAST_PART, -(-rows // PARTS))
    hot = classes.filter(F.col("n") > part).select("fp", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    dealt = lambda df: df.join(F.broadcast(hot), "fp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    named = dealt(named).select("fp", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("key", F.spark_partition_id()), F.col("parts")).cast("int").alias("salt")
    return dealt(marked).select("key", "fp", salt).join(named, ["fp", "salt"]).select(F.col("key").alias(key), "fp", "component")


def digests(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    return grouped.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
