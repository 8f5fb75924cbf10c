"""Near-duplicate documents: those linked by a similarity of 0.8 or more of their distinct five-word shingles.

Candidates are documents whose SimHash fingerprints (``simhash``, over five-word runs) are in one group. At a
similarity of 0.8 fingerprints differ by 4 to 14 bits, which no radius of two reaches; so documents that agree in a
band of minimum shingle hashes are candidates too (``BANDS`` bands of ``ROWS``: 99.9 % of pairs at 0.8, and
more above). What those miss an exact way finds: under one order of all shingles, two sets of the similarity share a
shingle among the first ``n - ceil(0.8 n) + 1`` of each (``prefix``), so that groups of the first ways that share such
a shingle are candidates as well. The order puts shingles last that are frequent in a sample; which ones those are
bears on the work alone.

Candidates that share a band or a shingle are a *run*. It is searched twice. First by *sketches*: a set's shingles flip
bits of a row of two to four bits a shingle, so that two sketches differ in no more bits than their sets in shingles; pairs that
differ in more than the similarity allows are let go, and so are pairs of one group already. What is left falls into parts,
which are verified on whole shingle sets. Both searches walk: they compare what they reach with all that is left, and
give a part number, or the edges of a spanning forest, never all pairs. A run of more than ``LONGEST`` sets or ``HELD``
bytes is dealt into blocks, each pair of which is a run of its own, so that no task holds more than two blocks and no pair is lost.

Copies (the same words in the same order) are one class and are never compared. Rows are numbered once and written with
their numbers, so that every reading means the same rows. Null texts are as empty ones, and those without words are
copies of each other; texts of fewer than five words are one shingle; very long ones are read whole. Of a group the document of the
least key stays (a null key last; of repeated keys one row). An empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

K, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 3
#: Most sets of a block, and bytes of sketches or of shingle sets.
LONGEST, HELD = 4096, 32 << 20
#: Most row numbers that are broadcast (8 bytes each); beyond that the join shuffles.
MOST_BROADCAST = 1_000_000
#: Classes whose shingles are counted for the order, and most frequent shingles that are broadcast.
SAMPLED, FREQUENT = 20_000, 200_000
_RNG = np.random.default_rng(20)
_TURN, _FLIP = (_RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def shingle_hashes(text: bytes | None, k: int = K) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    own = simhash.runs(text, k)
    return np.fromiter([digest(r, simhash.SEED) for r in own], dtype=np.uint64, count=len(own))


def bands(shingles: np.ndarray) -> list[int]:
    """A number for each band of minimum hashes; none of an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192, None]
        least = np.minimum(least, ((part ^ _FLIP) * _TURN).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), i)).view(np.int64)) for i, r in enumerate(rows)]


def sketch(shingles: np.ndarray) -> bytes:
    """A row of bits, a power of two and at least two for each distinct shingle; each shingle flips one."""
    size = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: int, size: int, to: int) -> int:
    """A sketch of ``size`` bits as one of ``to`` bits."""
    while size > to:
        size //= 2
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first of distinct shingles in the order by (count, hash), as many as a set of the similarity cannot all miss."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def marked(rows: DataFrame) -> DataFrame:
    """(row, key, copy, fp, bands, size, sketch) of rows (row, key, text): class of copies, fingerprint, bands, number of shingles, sketch."""

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, 2):
                copy, fp, own, size, bits = [], [], [], [], []
                for t in part.column(2).to_pylist():
                    h = shingle_hashes(t)
                    copy.append(xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split())))
                    fp.append(simhash.majority(h) if len(h) else 0)
                    h = np.unique(h)
                    own.append(bands(h))
                    size.append(len(h))
                    bits.append(sketch(h))
                columns = [part.column(0), part.column(1), pa.array(copy, pa.binary()), pa.array(fp, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "copy", "fp", "bands", "size", "sketch"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, key {kind}, copy binary, fp long, bands array<long>, size long, sketch binary")


class Sketches:
    """Sketches of one run, for comparing one with many."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]):
        self.sizes, self.lengths = sizes, np.array([8 * len(b) for b in bits], dtype=np.int64)
        self.small = [int.from_bytes(b, "little") for b in bits] if len(bits) <= 16 else None
        if self.small is None:
            # Of each length: the sketches that are compared there, of that length or folded to it.
            self.at, self.tables = {}, {}
            for length in np.unique(self.lengths).tolist():
                who = np.flatnonzero((self.lengths == length) | (self.lengths == 2 * length))
                table = np.zeros((len(who), length // 64), dtype=np.uint64)
                for i, w in enumerate(who.tolist()):
                    own = np.frombuffer(bits[w], dtype=np.uint64)
                    table[i] = own if len(own) == length // 64 else own[: length // 64] ^ own[length // 64 :]
                self.at[length], self.tables[length] = who, table

    def apart(self, x: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``left`` with sketches as long as x's or twice or half as long, and in how many bits they differ from it."""
        if self.small is not None:
            a, n, out = self.small[x], int(self.lengths[x]), []
            for y in left.tolist():
                b, m = self.small[y], int(self.lengths[y])
                short = min(n, m)
                out.append((folded(a, n, short) ^ folded(b, m, short)).bit_count())
            return left, np.array(out, dtype=np.int64)
        length, who, differ = int(self.lengths[x]), [], []
        for at in (length, length // 2):  # longer ones are folded to x's length, and x to that of shorter ones
            if at not in self.tables:
                continue
            own = self.at[at]
            pick = np.isin(own, left) & ((self.lengths[own] == at) | (at == length))
            mine = self.tables[at][np.searchsorted(own, x)]
            who.append(own[pick])
            differ.append(np.bitwise_count(self.tables[at][pick] ^ mine).sum(axis=1, dtype=np.int64))
        return np.concatenate(who), np.concatenate(differ)


def parts(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, bits: list[bytes], least: float) -> np.ndarray:
    """A number for each set of a run: those that may be linked have the same, and those that no other may be linked with -1."""
    m, out = len(nodes), np.full(len(nodes), -1, dtype=np.int64)
    if not (roots != roots[0]).any():
        return out
    sketches, left = Sketches(sizes, bits), np.ones(m, dtype=bool)
    for first in range(m):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack:
            x = stack.pop()
            may = left & (roots != roots[x]) & (np.minimum(sizes, sizes[x]) >= least * np.maximum(sizes, sizes[x]) - 1e-9)
            rest = np.flatnonzero(may)
            if not len(rest):
                continue
            who, differ = sketches.apart(x, rest)
            both = sizes[who] + sizes[x]
            near = who[differ <= both - 2 * np.ceil(least / (1 + least) * both - 1e-9)]
            if len(near):
                out[first] = out[x] = out[near] = nodes[first]
                left[near] = False
                stack.extend(near.tolist())
    return out


def verified(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of sets with a Jaccard similarity of ``least`` or more."""
    m = len(nodes)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(nodes[0]), int(nodes[1]))] if both and both >= least * (sizes.sum() - both) - 1e-9 else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    left, out = np.ones(m, dtype=bool), []
    for first in range(m):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack and left.any():
            x = stack.pop()
            a, b = np.searchsorted(flat, sets[x], side="left"), np.searchsorted(flat, sets[x], side="right")
            n = b - a
            at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=m)
            near = np.flatnonzero(left & (both > 0) & (both >= least * (sizes[x] + sizes - both) - 1e-9))
            out += [(int(nodes[x]), int(nodes[y])) for y in near]
            left[near] = False
            stack.extend(near.tolist())
    return out


def _among(df: DataFrame, rows: DataFrame, how: str, on: str = "row") -> DataFrame:
    """Joins on row numbers: broadcast while their number is checked to be small, else by a shuffle."""
    return df.join(F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows, on, how)


def salted(left: DataFrame, right: DataFrame, on: str, by: str = "row", how: str = "inner") -> DataFrame:
    """A join on a column of which one value may hold a third of the left rows; the right one has each value once."""
    n = simhash.SALTS
    left = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    right = right.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    return left.join(right, [on, "salt"], how).drop("salt")


def links(classes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): edges between classes (node, fp, bands, size, sketch) that connect all of the similarity; rows: (row, text)."""
    scratch = common.Scratch(rows.sparkSession)
    facts = classes.select("node", F.col("node").alias("root"), "size", "sketch")
    roots = components(simhash.links(classes.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    own = classes.join(roots, "fp", "left").select("node", F.concat("bands", F.array(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")))).alias("bands"))
    first = scratch.written(_edges(own.select("node", F.explode(F.array_distinct("bands")).alias("band")), facts, rows, similarity, scratch))
    grouped = scratch.written(facts.drop("root").join(components(first), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "sketch"))
    more = _edges(_shared_prefixes(grouped.select("node", "root"), rows, similarity, scratch), grouped, rows, similarity, scratch)
    out = common.written(first.unionByName(more).distinct())
    scratch.clear()
    return out


def _frequent(classes: int, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of rows have, in order, and in how many."""

    def every(batches):
        for batch in batches:
            for part in common.steps(batch, 1):
                for t in part.column(1).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t)).view(np.int64))], names=["shingle"])

    drawn = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, classes // SAMPLED))) == 0)
    counted = drawn.mapInArrow(every, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingles, n = (np.asarray(counted.column(i), dtype=np.int64) for i in (0, 1))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], n[order]


def _shared_prefixes(classes: DataFrame, rows: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame:
    """(node, band): of classes (node, root) each prefix shingle that classes of several roots have, once for each set of classes."""
    many = classes.count()
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(many, rows))

    def firsts(batches):
        frequent, counts = shared.value
        for batch in batches:
            for part in common.steps(batch, 1):
                got = [prefix(np.unique(shingle_hashes(t)), frequent, counts, similarity).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], names=["node", "prefix"])

    own = rows.mapInArrow(firsts, "node long, prefix array<long>")
    placed = own.join(F.broadcast(classes) if many <= MOST_BROADCAST else classes, "node")
    placed = scratch.written(placed.select("node", "root", F.explode("prefix").alias("band")))
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    met = scratch.written(placed.join(several, "band", "left_semi").select("node", "band"))
    return scratch.written(_once(met, ["band"]))


def _once(met: DataFrame, run: list[str]) -> DataFrame:
    """Of runs with the same nodes one: two documents that share one shingle or band mostly share many."""
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s")]
    one = met.groupBy(*run).agg(*mark).groupBy("n", "x", "s").agg(F.min(F.struct(*run)).alias("one")).select("one.*")
    return met.join(one, run, "left_semi")


def _dealt(places: DataFrame, size) -> DataFrame:
    """(node, run): places (node, band) of bands with several nodes; of one with too many, each pair of its blocks is a run."""
    blocks = F.ceil(F.greatest(F.count("*") / LONGEST, F.sum(size) / HELD)).cast("int")
    several = places.groupBy("band").agg(F.count("*").alias("n"), blocks.alias("blocks")).filter("n > 1").select("band", "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    shared = salted(places, several, "band", "node").select("band", "node", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    return shared.select("node", F.concat_ws(":", "band", F.least("x", "y"), F.greatest("x", "y")).alias("run"))


def _runs(batches, columns: int):
    """Of sorted rows whose first column is the run: (run, lists of the other columns), a run at a time."""
    run, held = None, [[] for _ in range(columns)]
    for batch in batches:
        own = [c.to_pylist() for c in batch.columns]
        for i, r in enumerate(own[0]):
            if r != run:
                if held[0]:
                    yield run, held
                run, held = r, [[] for _ in range(columns)]
            for h, c in zip(held, own[1:], strict=True):
                h.append(c[i])
    if held[0]:
        yield run, held


def _edges(places: DataFrame, facts: DataFrame, rows: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame:
    """(a, b): edges that connect all of the similarity, but for those of one root, among those that share a band of places (node, band)."""
    # A set of n shingles has a sketch of n / 2 bytes at most.
    dealt = _dealt(places.join(facts.select("node", "size"), "node"), F.col("size") / 2 + 64)
    together = dealt.join(facts, "node").select("run", "node", "root", "size", "sketch").repartition("run").sortWithinPartitions("run")

    def compare(batches):
        for run, (node, root, size, bits) in _runs(batches, 4):
            nodes = np.array(node, dtype=np.int64)
            got = parts(nodes, np.array(root, dtype=np.int64), np.array(size, dtype=np.int64), bits, similarity)
            keep = np.flatnonzero(got >= 0)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array([f"{run}:{p}" for p in got[keep].tolist()]), pa.array(nodes[keep])], names=["band", "node"])

    near = scratch.written(together.mapInArrow(compare, "band string, node long"))
    near = scratch.written(_dealt(_once(near, ["band"]).join(facts.select("node", "size"), "node"), F.col("size") * 8 + 64))
    wanted = scratch.written(near.select(F.col("node").alias("row")).distinct())

    def sets(batches):
        for batch in batches:
            for part in common.steps(batch, 1):
                got = [np.unique(shingle_hashes(t)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], names=["node", "shingles"])

    whole = _among(rows, wanted, "left_semi").mapInArrow(sets, "node long, shingles binary")
    met = near.join(whole, "node").select("run", "node", "shingles").repartition("run").sortWithinPartitions("run")

    def search(batches):
        for _, (node, held) in _runs(batches, 2):
            edges = verified(np.array(node, dtype=np.int64), [np.frombuffer(s, dtype=np.uint64) for s in held], similarity) if len(node) > 1 else []
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return met.mapInArrow(search, "a long, b long").distinct()


def extra(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row): of rows (row, key, text), a stored table, the numbers of those that are near copies of one that stays."""
    scratch, text = common.Scratch(rows.sparkSession), rows.select("row", "text")
    every = scratch.written(marked(rows.select("row", "key", "text")))
    order = F.struct(F.col("key").isNull(), "key", "row")
    facts = F.min_by(F.struct("row", "fp", "bands", "size", "sketch"), "row")
    classes = every.groupBy("copy").agg(facts.alias("f"), F.min_by(F.struct("key", "row"), order).alias("least"))
    classes = scratch.written(classes.select("copy", F.col("f.row").alias("node"), "f.fp", "f.bands", "f.size", "f.sketch", "least"))
    linked = links(classes, text, similarity)
    roots = components(linked)
    grouped = classes.join(roots, "node", "left").select("copy", "least", F.coalesce("root", "node").alias("root"))
    stays = grouped.groupBy("root").agg(F.min_by("least", F.struct(F.col("least.key").isNull(), "least.key", "least.row")).alias("least"))
    named = grouped.join(stays.select("root", F.col("least.row").alias("stays")), "root").select("copy", "stays")
    out = common.written(salted(every.select("row", "copy"), named, "copy").filter("row <> stays").select("row"))
    scratch.clear()
    return out


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group."""
    common.small_batches(docs.sparkSession)
    row = common.unused("__row", docs.columns)
    rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = extra(rows.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), similarity)
    return _among(rows, gone.withColumnRenamed("row", row), "left_anti", row).select(*[F.col(f"`{c}`") for c in docs.columns])
