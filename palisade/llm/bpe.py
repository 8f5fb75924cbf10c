"""Byte-pair encoding and decoding with a given vocabulary file, in batched numpy merge rounds.

The tokenizer is one whose file describes: NFC, runs of white space as one space, lower case; a split into
contractions, runs of letters, single digits and runs of other signs; byte-level symbols; merges by rank with a
word-end suffix. Texts are cut at white space, and a Python worker keeps the ids of chunks that it has met: two generations of
``CACHED`` chunks, so that frequent ones stay and memory is bounded. The symbols of all new words lie in one flat
array with the rank of every neighbouring pair, found by binary search over the sorted pair keys; each round
merges the lowest-ranked pair of each word wherever it stands and searches anew only the pairs beside a merge, until no pair is left.

Null texts are as empty ones and have no tokens; very long texts are encoded whole; rows are kept one to one, repeated ones
and null ids too, whatever other columns they have; an empty table gives no rows. Ranks have no ties. The
vocabulary is the only thing broadcast: its size is that of the file, whatever the corpus.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Distinct chunks of text of a generation that a worker keeps encoded (results do not depend on it).
CACHED = 100_000
#: Bytes of text that are encoded at a time; their chunks are many small objects.
STEP = 1 << 20
NO_RANK = np.int32(1 << 30)
_CONTROLS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


# Code points that the pattern's library (Unicode 16) has as unassigned, and the regex module as letters or digits.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1
1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def split_pattern(pattern: str):
    """The file's pattern, compiled with the letters and digits of its own library's Unicode version."""
    newer = "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (x.split("-") for x in NEWER.split()))
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
    return regex.compile(f"(?V1){pattern}")


class Vocabulary:
    """What encoding needs of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.tokens = [""] * self.size
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        signs = byte_symbols()
        self.inner = np.array([ids[s] for s in signs], dtype=np.int32)
        self.final = np.array([ids[s + suffix] for s in signs], dtype=np.int32)
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in model["merges"]), strict=True))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made[order].astype(np.int32)
        born = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        #: No merge uses a token before a merge makes it; so equal pairs of a word can be merged in one round.
        self.ordered = bool((born[left] < np.arange(len(made))).all() and (born[right] < np.arange(len(made))).all())
        self.words = split_pattern(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        #: What every special token begins with: texts without it have none.
        self.mark = os.path.commonprefix(list(self.special))
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))

    def encoder(self) -> Encoder:
        """One encoder as long as this object lives: in a worker, as long as it keeps the broadcast."""
        if not hasattr(self, "_encoder"):
            self._encoder = Encoder(self)
        return self._encoder


def merged(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids of each word (UTF-8 bytes, not empty), as bytes of 32-bit numbers."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    last = np.cumsum(sizes) - 1
    symbol = v.inner[raw]
    symbol[last] = v.final[raw[last]]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ended: list[tuple[np.ndarray, np.ndarray]] = []  # words without a pair left: (word, symbol) of each symbol

    def found(left, right):
        """Rank of each pair, and what it is merged to."""
        pair = symbol[left].astype(np.int64) * v.size + symbol[right]
        at = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
        return np.where((v.keys[at] == pair) & (word[left] == word[right]), v.ranks[at], NO_RANK), v.made[at]

    # rank[i], into[i]: of the pair of symbols i and i + 1; the last of a word has none.
    place = np.arange(len(symbol))
    rank, into = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), dtype=np.int32)
    if len(symbol):
        rank[:-1], into[:-1] = found(place[:-1], place[1:])
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.r_[starts, len(symbol)])
        least_here = np.repeat(least, counts)
        over = least_here >= NO_RANK
        if over.any():
            ended.append((word[over], symbol[over]))
            go = ~over
            symbol, word, rank, into, least_here = symbol[go], word[go], rank[go], into[go], least_here[go]
            if not len(symbol):
                break
        take = rank == least_here
        if v.ordered:  # where a pair overlaps itself, every second place from the left
            spot = np.arange(len(take))
            begins = np.maximum.accumulate(np.where(take & ~np.r_[False, take[:-1]], spot, -1))
            take &= (spot - begins) % 2 == 0
        else:  # the leftmost place only
            where = np.flatnonzero(take)
            first = where[np.r_[True, word[where][1:] != word[where][:-1]]]
            take = np.zeros(len(take), dtype=bool)
            take[first] = True
        symbol[take] = into[take]
        keep = ~np.r_[False, take[:-1]]
        symbol, word, rank, into, take = symbol[keep], word[keep], rank[keep], into[keep], take[keep]
        new = np.flatnonzero(take | np.r_[take[1:], False])  # pairs that a merged symbol begins or ends
        last = len(symbol) - 1
        rank[new] = NO_RANK
        new = new[new < last]
        rank[new], into[new] = found(new, new + 1)
    word, symbol = (np.concatenate(x) for x in zip(*ended, strict=True)) if ended else (word, symbol)
    flat = symbol[np.argsort(word, kind="stable")].tobytes()
    ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts; keeps the ids of chunks that it has seen as bytes of 32-bit numbers, in two generations."""

    def __init__(self, v: Vocabulary):
        self.v, self.seen, self.before = v, {}, {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma has no form of its own here
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        text = self.normal(text)
        return regex.split(r"\s+", text) if _CONTROLS.search(text) else text.split()

    def learn(self, new: set[str]) -> None:
        plain = [c for c in new if c.isascii() and c.isalpha()]  # a run of letters is one word
        rest = list(new.difference(plain))
        parts = [self.v.words.findall(c) for c in rest]
        words = list({w for p in parts for w in p}.union(plain))
        ids = dict(zip(words, merged([w.encode() for w in words], self.v), strict=True))
        self.seen.update((c, ids[c]) for c in plain)
        self.seen.update(zip(rest, (b"".join([ids[w] for w in p]) for p in parts), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        pieces = []  # of each text: lists of chunks, and ids of special tokens
        for t in texts:
            own, at = [], 0
            for m in self.v.added.finditer(t) if t and self.v.special and self.v.mark in t else ():
                own += [self.chunks(t[at : m.start()]), self.v.special[m[0]]]
                at = m.end()
            pieces.append([*own, self.chunks(t[at:])] if t else [])
        if len(self.seen) > CACHED:
            self.before, self.seen = self.seen, {}
        new = set().union(*(p for own in pieces for p in own if isinstance(p, list))).difference(self.seen)
        for c in new.intersection(self.before):
            self.seen[c] = self.before[c]
        new.difference_update(self.before)
        if new:
            self.learn(new)
        get = self.seen.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else np.int32(p).tobytes() for p in own) for own in pieces]


def _lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) // 4 for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of a text column (array<int>), and with ``decoded`` the text that these ids decode to.

    tokenizer: the vocabulary file's path. New columns take the place of columns of the same name.
    """
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    fields = [*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    source = "__text"
    while source in df.columns:
        source += "_"

    def run(batches):
        v = shared.value
        encoder, tokens = v.encoder(), pa.array(v.tokens)
        for batch in batches:
            for part in common.steps(batch, batch.num_columns - 1, STEP):
                got = _lists(encoder.encode(part.column(part.num_columns - 1).to_pylist()))
                columns = [*part.columns[:-1], got]
                if decoded:
                    columns.append(pc.binary_join(pa.ListArray.from_arrays(got.offsets, tokens.take(got.values)), " "))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias(source)).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that a column of token ids decodes to: the tokens joined by spaces; null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer).tokens)
    schema = T.StructType([f for f in df.schema.fields if f.name != decoded] + [T.StructField(decoded, T.StringType())])
    at = [f.name for f in schema.fields[:-1]].index(ids)

    def run(batches):
        tokens = pa.array(shared.value)
        for batch in batches:
            own = batch.column(at).to_pylist()
            text = pa.array([" ".join(tokens.take(pa.array(x, pa.int32())).to_pylist()) if x else "" for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in schema.fields[:-1]]).mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> list:
    """The columns n_tokens, ids_sha256 and decoded_sha256 of encoded rows."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
