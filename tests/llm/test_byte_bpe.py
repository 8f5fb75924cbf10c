"""Byte-level encoding, held against the public library of the rank file and against a plain merge loop."""

import base64
import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

from palisade.llm import byte_bpe, registered  # noqa: E402

PATH, PATTERN = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    None, "", " ", "\n\n \t x", "a", "it's we'll I'D 's's", " '", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "tail  ", "x   y　z", "<|endoftext|>",
    "ångström Σς 𝔘𝔫𝔦 日本語のテキスト 한국어 \U0001f600\U0001f468‍\U0001f469", "12345 1٣٤ ½²", "\x00\x1c\x85 ﻿", "é" * 40, "՘࢏\U00010940 new", "=" * 300, "Donaudampfschifffahrt" * 60,
]


def test_equals_the_library_on_odd_and_random_texts(spark, library):
    rng = random.Random(5)
    signs = "aabcdeest '\n\t.,-0129äéñßЖ語 \U0001f600"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(300)] + ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    rows = byte_bpe.encode(df, PATH, PATTERN, decoded="decoded").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.token_ids == library.encode_ordinary(text), text
        assert bytes(r.decoded) == text.encode()


def test_trees_merge_as_a_plain_loop():
    r = byte_bpe.Ranks(PATH, PATTERN)
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"aeinrst ") for _ in range(rng.randrange(2, 90))) for _ in range(300)] + [bytes(rng.randrange(256) for _ in range(33)) for _ in range(30)] + [b"ab" * 700]
    for piece, got in zip(pieces, byte_bpe.merged(pieces, r), strict=True):
        parts = [piece] if piece in r.ranks else [bytes([b]) for b in piece]
        while True:
            best = min(((r.ranks.get(a + b, byte_bpe.NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(byte_bpe.NONE, 0))
            if best[0] == byte_bpe.NONE:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert got == b"".join(r.ranks[p].to_bytes(4, "little") for p in parts)


def test_small_caches_and_batches_give_the_same(spark, monkeypatch, library):
    e = byte_bpe.Encoder(byte_bpe.Ranks(PATH, PATTERN))
    monkeypatch.setattr(byte_bpe, "CACHED", 5)
    monkeypatch.setattr(byte_bpe, "LEAVES", 16)
    for _ in range(2):
        for t in ODD[1:]:
            assert e.encode([t])[0] == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t))


def test_round_trip_query_and_odd_tables(spark, library, sf_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registered.op12_byte_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
    empty = spark.createDataFrame([], "text string, `a.b` int")
    assert byte_bpe.encode(empty, PATH, PATTERN).collect() == []
    repeated = spark.createDataFrame([(None, "so it is"), (None, "so it is")], "`a.b` int, text string")
    encoded = byte_bpe.encode(repeated, PATH, PATTERN)
    assert [bytes(r.decoded) for r in byte_bpe.decode(encoded, PATH).collect()] == [b"so it is"] * 2
