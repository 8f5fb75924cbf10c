"""Hard negatives for contrastive training: exact integer scores by residues, then windowed selection.

Components are multiplied by a scale and rounded down; a score is the inner product of two such vectors, as an exact integer. Matrices of
anchors and rows are multiplied once for each of several primes under 256, as float32 matrices of residues around zero: over
``SPAN`` components such a sum stays under 2 ** 24, so float32 holds it exactly. The signed score comes back from its residues by
Chinese remaindering in mixed radix; as many primes are taken as the norms of the two blocks call for.

Anchors are a query set. They are broadcast in blocks of at most ``ANCHOR_BYTES`` (one block after the other), and each task
multiplies them with its own rows, in tiles of ``TILE`` by ``TILE``, and keeps the best few for each anchor, so that only these are
shuffled: a task sends at most ``positives`` rows an anchor, or ``negatives`` rows an anchor and positive, whatever it has read. Rows with
equal vectors, labels or scores thus meet nowhere in number. Two passes are made, as the windows of negatives follow from positives.

Rows with a null label, a null vector, or a null or non-finite component take no part. An anchor's "other rows" are those of another id; a
null id is an id of its own that comes last among ties. Repeated rows are rows like others, but an anchor that is
repeated exactly gives its results once. Shorter vectors are as ones filled up with zeros, an empty one scores 0. Components are held within
2 ** 140 (what the scale makes of any float is), scores within 63 bits. Empty tables, and tables without anchors, give
no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of anchors that are broadcast at a time.
ANCHOR_BYTES = 32 << 20
#: Anchors and rows that are multiplied at a time.
TILE = 1024
#: Components over which one float32 sum runs: SPAN * 125 ** 2 < 2 ** 24.
SPAN = 1024
PRIMES = [p for p in range(251, 2, -2) if all(p % d for d in range(3, 16, 2))]
LIMIT = (1 << 63) - 1
MOST = 2.0**140


class Residues:
    """Integer vectors (whole numbers as float64) and their residues by prime, made when asked for."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norm, self.made = vectors, float(np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0)), {}

    def of(self, prime: int) -> np.ndarray:
        if prime not in self.made:
            left = np.fmod(self.vectors, prime)  # exact, whatever the size
            half = prime // 2
            self.made[prime] = (left - prime * (left > half) + prime * (left < -half)).astype(np.float32)
        return self.made[prime]


def scores(a: Residues, b: Residues) -> np.ndarray:
    """The inner product of each vector of ``a`` with each of ``b``: exact, held within 63 bits."""
    bound, taken, product = int(a.norm * b.norm * 1.001) + 1, [], 1
    while product <= 2 * bound:
        taken.append(PRIMES[len(taken)])
        product *= taken[-1]
    digits: list[np.ndarray] = []  # mixed radix: x = d0 + p0 * (d1 + p1 * (d2 + ...))
    for i, p in enumerate(taken):
        left, right = a.of(p), b.of(p)
        rest = np.zeros((len(left), len(right)), dtype=np.int32)
        for k in range(0, max(1, left.shape[1]), SPAN):
            rest += (left[:, k : k + SPAN] @ right[:, k : k + SPAN].T).astype(np.int32) % p
        for q, d in zip(taken[:i], digits, strict=True):
            rest = (rest - d) % p * pow(q, -1, p)
        digits.append(rest % p)
    wide = product >= 1 << 62
    out = np.zeros((len(a.vectors), len(b.vectors)), dtype=object if wide else np.int64)
    for p, d in zip(reversed(taken), reversed(digits), strict=True):
        out *= p
        out += d.astype(object) if wide else d
    out[out > product // 2] -= product
    return np.clip(out, -LIMIT, LIMIT).astype(np.int64) if wide else out


class Best:
    """The first ``k`` of each slot by score, descending, and id (nulls last), of what has been offered so far."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.floor = k, least.copy()  # the least score that can still enter
        self.slot, self.score, self.id, self.void = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, slot, score, ident, void) -> None:
        """Offers come in the order of their ids, so that a later one of equal score never displaces an earlier one."""
        slot, score = np.r_[self.slot, slot], np.r_[self.score, score]
        ident, void = np.r_[self.id, ident], np.r_[self.void, void]
        order = np.lexsort((ident, void, -score, slot))
        slot = slot[order]
        spot = np.arange(len(slot))
        begins = np.maximum.accumulate(np.where(np.r_[True, slot[1:] != slot[:-1]], spot, 0)) if len(slot) else spot
        keep = spot - begins < self.k
        order, full = order[keep], (spot - begins)[keep] == self.k - 1
        self.slot, self.score, self.id, self.void = slot[keep], score[order], ident[order], void[order]
        held = self.score[full]
        self.floor[self.slot[full]] = np.where(held < LIMIT, held + 1, LIMIT)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, rounded down and filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.clip(np.floor(out), -MOST, MOST)


def _fitted(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Anchors:
    """One block of anchors, in tiles; ``low`` and ``high`` are the windows of scores of each anchor and positive."""

    def __init__(self, ids: np.ndarray, void: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.void, self.labels, self.vectors = ids, void, labels, vectors
        self.tiles: dict[int, list[Residues]] = {}

    def cut(self, width: int) -> list[Residues]:
        if width not in self.tiles:
            self.tiles = {width: [Residues(_fitted(self.vectors[i : i + TILE], width)) for i in range(0, len(self.ids), TILE)]}
        return self.tiles[width]


def _selected(batches, anchors: Anchors, same: bool, k: int, low: np.ndarray, high: np.ndarray):
    """The best ``k`` rows of one task for each anchor and window (a row of ``low`` and ``high`` is an anchor's windows)."""
    windows = low.shape[1]
    best = Best(low.size, k, low.ravel())
    step = 64  # the first rows set what later ones have to reach
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = batch.slice(at, step)
            at, step = at + rows.num_rows, min(TILE, 2 * step)
            ids = np.asarray(rows.column(0).fill_null(0), dtype=np.int64)
            void = np.asarray(rows.column(0).is_null())
            labels = np.asarray(rows.column(1), dtype=np.int64)
            vectors = _matrix(rows.column(2), anchors.vectors.shape[1])
            right = Residues(vectors)
            for t, left in enumerate(anchors.cut(vectors.shape[1])):
                own = slice(t * TILE, t * TILE + len(left.vectors))
                got = scores(left, right)
                fits = (anchors.labels[own, None] == labels) == same
                fits &= (anchors.ids[own, None] != ids) | (anchors.void[own, None] != void)
                for w in range(windows):
                    slots = np.arange(own.start, own.stop) * windows + w
                    a, r = np.nonzero(fits & (got >= best.floor[slots, None]) & (got <= high[own, w, None]))
                    if len(a):
                        best.offer(slots[a], got[a, r], ids[r], void[r])
    yield pa.RecordBatch.from_arrays(
        [pa.array(best.slot // windows), pa.array(best.slot % windows), pa.array(best.score), pa.array(best.id, mask=best.void)], names=["anchor", "window", "score", "id"]
    )


_FOUND = "anchor long, window long, score long, id long"


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    ids, labels, vectors = (pa.concat_arrays(c.chunks) for c in anchors.columns)
    block = Anchors(np.asarray(ids.fill_null(0), dtype=np.int64), np.asarray(ids.is_null()), np.asarray(labels, dtype=np.int64), _matrix(vectors, 0))
    n = len(block.ids)
    shared = spark.sparkContext.broadcast(block)

    def nearest(batches):
        yield from _selected(batches, shared.value, True, positives, np.full((n, 1), -LIMIT), np.full((n, 1), LIMIT))

    # At most ``positives`` rows for each anchor of one block.
    chosen = _first(rows.mapInArrow(nearest, _FOUND), positives).select("anchor", "rank", "score", "id").toPandas()
    near = np.zeros((n, positives), dtype=np.int64)
    low, high = np.full((n, positives), LIMIT), np.full((n, positives), -LIMIT)  # no such positive: no window
    name: list[list[int | None]] = [[None] * positives for _ in range(n)]
    for a, rank, score, ident in zip(chosen["anchor"], chosen["rank"], chosen["score"], chosen["id"], strict=True):
        score = int(score)
        near[a, rank - 1], name[a][rank - 1] = score, None if ident is None or ident != ident else int(ident)
        low[a, rank - 1], high[a, rank - 1] = -(-share[0] * score // 100), share[1] * score // 100
    windows = spark.sparkContext.broadcast((near, name, low, high))

    def hard(batches):
        block, (near, name, low, high) = shared.value, windows.value
        for out in _selected(batches, block, False, negatives, low, high):
            a, w = np.asarray(out.column(0)), np.asarray(out.column(1))
            columns = [pa.array(block.ids[a], mask=block.void[a]), pa.array([name[i][j] for i, j in zip(a.tolist(), w.tolist(), strict=True)], pa.int64()), pa.array(near[a, w])]
            yield pa.RecordBatch.from_arrays([*out.columns, *columns], names=[*out.schema.names, "anchor_id", "positive_id", "positive_score"])

    found = rows.mapInArrow(hard, f"{_FOUND}, anchor_id long, positive_id long, positive_score long")
    return _first(found, negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(
    df: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    anchor: a condition on the columns of ``df``; ids and labels have to be whole numbers. An anchor's positives are its first ``positives`` other rows of its label. A
    negative is a row of another label whose score lies within ``share`` per cent of the positive's, both ends included; the first
    ``negatives`` of each are returned. Higher scores come first, ties by smaller id.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(scale)).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    chosen = rows.filter("is_anchor").select("id", "label", "vector").distinct()
    scratch = common.Scratch(df.sparkSession)
    chosen = scratch.written(chosen)
    count, width = chosen.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = -(-count * (8 * (width or 0) + 32) // ANCHOR_BYTES)
    common.small_batches(df.sparkSession)
    rows = rows.select("id", "label", "vector").sortWithinPartitions(F.asc_nulls_last("id"))
    out = None
    for b in range(blocks):
        own = chosen.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            part = _block(rows, own, positives, negatives, share)
            part = common.written(part) if blocks > 1 else part
            out = part if out is None else out.unionByName(part)
    scratch.clear()
    if out is None:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


#: The query in DuckDB's SQL, for the table ``embeddings``.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.other_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER best <= 10
"""
