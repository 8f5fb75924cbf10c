"""Byte-level byte-pair encoding and decoding by a file of ranks, with a segment tree over the bytes of each piece.

Texts are cut into pieces by a pattern, and each piece is encoded on its own: a piece that is a token is that token; else, as
long as two neighbouring symbols make a token when joined, the pair whose token has the least rank is joined, the leftmost one of
equals. The leaves of a piece's segment tree are its byte positions: each live position holds (rank of the pair that
starts there, position), others hold infinity, and inner nodes hold the least of their children. The root is thus the next merge, at its
leftmost place; a merge writes three leaves (the joined symbol, its right part, its left neighbour) and the nodes above them.
Pieces of like length are stacked, so that one numpy step makes one merge in each of them; every piece merges by its own root.

A Python worker keeps the ids of pieces that it has met: two generations of ``CACHED`` pieces, so that frequent ones stay and
memory is bounded. Trees are built for at most ``LEAVES`` positions at a time (one piece at least).

Null texts are as empty ones and have no tokens; very long texts are encoded whole, and a piece of n bytes costs n log n; rows are kept one
to one, repeated ones and null ids too, whatever other columns they have; an empty table gives no rows. Ties of ranks go
to the leftmost place. The ranks are the only thing broadcast: their size is that of the file, whatever the corpus.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import _lists, split_pattern

#: Pieces of a generation that a worker keeps encoded (results do not depend on it).
CACHED = 200_000
#: Bytes of text that are encoded at a time; their pieces are many small objects.
STEP = 2 << 20
#: Byte positions whose trees are held at a time.
LEAVES = 1 << 19
NONE = np.int64(1) << 60


class Ranks:
    """A rank file: ``tokens[i]`` are the bytes of token i; sorted keys of all pairs that make a token when joined."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.pattern, self.size = pattern, 1 + max(ranks.values())
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.keys, self.made = (np.array(x, dtype=np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.array([-1]), np.array([NONE]))

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair of tokens makes, or NONE."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.made[at], NONE)

    def encoder(self) -> Encoder:
        """One encoder as long as this object lives: in a worker, as long as it keeps the broadcast."""
        if not hasattr(self, "_encoder"):
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_encoder"}


def _merged_alike(pieces: list[bytes], depth: int, r: Ranks) -> list[bytes]:
    """Token ids of pieces of 2 to 2 ** depth bytes, as bytes of 32-bit numbers."""
    width, n = 1 << depth, len(pieces)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    cell = np.repeat(np.arange(n) * width, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbol = np.full(n * width, -1, dtype=np.int64)  # by piece and position; -1 where no symbol starts
    symbol[cell] = r.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.tile(np.arange(1, width + 1), n)  # position of the next and the last live symbol of the piece
    before = np.tile(np.arange(-1, width - 1), n)
    end = sizes

    tree = np.full(n * 2 * width, NONE, dtype=np.int64)
    inner = cell[symbol[np.minimum(cell + 1, n * width - 1)] >= 0]
    inner = inner[inner % width < width - 1]
    pair = r.found(symbol[inner], symbol[inner + 1])
    at = inner % width
    tree[inner // width * 2 * width + width + at] = np.where(pair < NONE, (pair << depth) | at, NONE)
    nodes = tree.reshape(n, 2 * width)
    for level in range(depth - 1, -1, -1):
        below = nodes[:, 2 << level : 4 << level]
        nodes[:, 1 << level : 2 << level] = np.minimum(below[:, ::2], below[:, 1::2])

    live = np.arange(n)
    while True:
        root = tree[live * 2 * width + 1]
        go = root < NONE
        live, root = live[go], root[go]
        if not len(live):
            break
        own, base = live * width, live * 2 * width
        at, token = root & (width - 1), root >> depth
        right = after[own + at]
        further = after[own + right]
        left = before[own + at]
        symbol[own + at], symbol[own + right] = token, -1
        after[own + at] = further
        inside = further < end[live]
        before[(own + further)[inside]] = at[inside]
        # The three leaves that change: the joined symbol's, its right part's and its left neighbour's.
        follows = np.where(inside, r.found(token, symbol[own + np.where(inside, further, at)]), NONE)
        first = left < 0
        leads = np.where(first, NONE, r.found(symbol[own + np.where(first, at, left)], token))
        node = np.stack([base + width + right, base + width + np.where(first, right, left), base + width + at])
        tree[node[0]] = NONE
        tree[node[1]] = np.where(leads < NONE, (leads << depth) | left, NONE)
        tree[node[2]] = np.where(follows < NONE, (follows << depth) | at, NONE)
        node -= base
        for _ in range(depth):
            node >>= 1
            child = base + 2 * node
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
    left_over = symbol >= 0
    flat = symbol[left_over].astype(np.int32).tobytes()
    ends = (np.cumsum(left_over.reshape(n, width).sum(axis=1)) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merged(pieces: list[bytes], r: Ranks) -> list[bytes]:
    """Token ids of each piece (bytes, not empty), as bytes of 32-bit numbers."""
    out: list[bytes] = [b""] * len(pieces)
    alike: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = r.ranks.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        else:
            alike.setdefault((len(piece) - 1).bit_length(), []).append(i)
    for depth, own in alike.items():
        step = max(1, LEAVES >> depth)
        for a in range(0, len(own), step):
            some = own[a : a + step]
            for i, ids in zip(some, _merged_alike([pieces[i] for i in some], depth, r), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; keeps the ids of pieces that it has seen, in two generations."""

    def __init__(self, r: Ranks):
        self.r, self.seen, self.before = r, {}, {}
        self.find = split_pattern(r.pattern).findall

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.seen) > CACHED:
            self.before, self.seen = self.seen, {}
        new = set().union(*cut).difference(self.seen)
        for p in new.intersection(self.before):
            self.seen[p] = self.before[p]
        new = list(new.difference(self.before))
        self.seen.update(zip(new, merged([p.encode() for p in new], self.r), strict=True))
        get = self.seen.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]


def _placed(fields: list[T.StructField]) -> list:
    """Columns under plain names, as mapInArrow takes names with a dot in them apart."""
    return [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]


def _joined(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), b"")


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of a text column (array<int>), and with ``decoded`` the bytes that these ids decode to.

    ranks: path of a file of lines "base64 of the token, rank"; every byte has to be a token. pattern: what cuts texts into pieces.
    New columns take the place of columns of the same name.
    """
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Ranks(ranks, pattern))
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    fields = [*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))

    def run(batches):
        encoder, tokens = shared.value.encoder(), pa.array(shared.value.tokens, pa.binary())
        for batch in batches:
            for part in common.steps(batch, batch.num_columns - 1, STEP):
                got = _lists(encoder.encode(part.column(part.num_columns - 1).to_pylist()))
                columns = [*part.columns[:-1], got, *([_joined(got, tokens)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*_placed(kept), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ranks: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that a column of token ids decodes to; null ids give none, an id that is no token fails."""
    shared = df.sparkSession.sparkContext.broadcast(Ranks(ranks, "").tokens)
    schema = T.StructType([f for f in df.schema.fields if f.name != decoded] + [T.StructField(decoded, T.BinaryType())])
    at = [f.name for f in schema.fields[:-1]].index(ids)

    def run(batches):
        for batch in batches:
            out = [b"".join([shared.value[i] for i in x or ()]) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return df.select(*_placed(schema.fields[:-1])).mapInArrow(run, schema)
